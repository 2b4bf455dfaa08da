"""Deduplication, decontamination, quality and mixing against plain versions, with odd rows and hot groups."""

import random
from itertools import combinations

import brute
import pytest
from pyspark.sql import functions as F

from ordinalis.llm import common, decontaminate, line_dedup, mixing, near_dup, quality, suffix_dedup

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "pa", "ri", "so", "tu") for b in ("n", "r", "s", "th", "l", "ck")]
SCHEMA = "doc_id long, text string, source string, kept boolean, component_id long, copy int, n_lines int, key string"


def frame(spark, rows):
    """Documents with columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "s", False, 1, 2, 3, "k") for i, t in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [sentence(rng, 60) for _ in range(20)]
    shared = sentence(rng, 50)
    for k in range(60):  # one passage in many short texts: alike, but not enough
        texts.append(shared + " " + sentence(rng, 14 + k % 9))
    seed = sentence(rng, 80).split()
    for _ in range(40):  # near copies
        words = list(seed)
        words[rng.randrange(80)] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [texts[0]] * 30 + [texts[1].upper()] + ["one two", "one  two", "three"]
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, " \n "), (None, texts[2]), (3, texts[3])]
    rng.shuffle(rows)
    return rows


def plain_near(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= 75 * len(x | y) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted([(-1 if i is None else i, len(s), -1 if i is None else find(i), i is None or find(i) == i) for i, s in sets])


@pytest.mark.parametrize("small,block", [(32, 256), (2, 8)])
def test_near_duplicates(spark, corpus, monkeypatch, small, block):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    got = near_dup.near_duplicates(frame(spark, corpus).repartition(5)).fillna(-1).collect()
    assert sorted(tuple(r) for r in got) == plain_near(corpus)
    kept = near_dup.drop_near_duplicates(frame(spark, corpus))
    assert kept.columns == frame(spark, corpus).columns


def test_every_near_signature_shares_a_key():
    import numpy as np
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, near_dup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(near_dup.SYMBOLS, near_dup.MAX_DISTANCE, replace=False)] ^= 1
        x, y = (near_dup.chunk_keys(s.view(np.int64)) for s in (a, b))
        assert set(x.tolist()) & set(y.tolist())


def test_empty_tables(spark, corpus):
    none = frame(spark, corpus).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_dup.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, corpus), bench).count() == len(corpus)
    assert quality.quality(none).count() == 0
    assert suffix_dedup.repeated_bytes(none).count() == 0
    assert mixing.mix(none, mixing.temperature_weights(none)).count() == 0


@pytest.mark.parametrize("group", [2000, 4])
def test_repeated_bytes(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(8)
    hot = "this passage is found in many of the texts and it is well over a hundred bytes long, so that its anchors are hot"
    base = sentence(rng, 200)
    rows = [(k, sentence(rng, 40) + hot + sentence(rng, 40)) for k in range(25)] + [(30 + k, sentence(rng, 40) + hot * 3 + sentence(rng, 40)) for k in range(9)]
    rows += [(50, base), (51, base), (51, base), (52, base[:300] + "!" + base[300:]), (53, "a" * 500), (54, "ab" * 150 + "x"), (55, None), (56, ""), (57, "é" * 150),
             (58, "z" * 199), (None, base[100:600]), (59, sentence(rng, 3000)), (60, "q" * 200)]
    docs = frame(spark, rows).repartition(3)
    texts = docs.collect()
    want = sorted((str(r["doc_id"]), *w) for r, w in zip(texts, brute.repeated_bytes([r["text"] for r in texts]), strict=True))
    got = suffix_dedup.repeated_bytes(docs).drop("removed").collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == want


def test_only_contexts_that_share_a_middle_are_read_again(spark, monkeypatch):
    """A hot passage in different surroundings: the split of its anchor must not multiply the contexts."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 40)
    rng = random.Random(3)
    hot = "a passage that stands in all of the texts"
    texts = [(sentence(rng, 80), sentence(rng, 80)) for _ in range(150)]
    texts += [(texts[k][0], sentence(rng, 80)) for k in range(5)]  # the same before, not after
    hot_rows = []
    for k, (a, b) in enumerate(texts):
        data = f"{a}{hot}{b}".encode()
        hot_rows.append((7, k, 1, *suffix_dedup.context_row(data, len(a) + 4)))
    contexts = spark.createDataFrame(hot_rows, "key long, digest long, n long, before short, context binary")
    whole = contexts.withColumns({"low": F.lit(0), "high": F.lit(suffix_dedup.REACH)})
    assert suffix_dedup.slots_of(whole, suffix_dedup.SLOTS[0]).count() <= 2 * len(texts)
    parts, rest = suffix_dedup.split(contexts)
    got = parts.collect()
    assert rest is None and sorted(r["digest"] for r in got) == [*range(5), *range(150, 155)]
    assert all(bytes(r["context"]) == hot_rows[r["digest"]][4] and (r["low"], r["high"]) == (91, 168) for r in got)


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(500):
        text = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])  # noqa: B023


def test_line_dedup(spark):
    rng = random.Random(4)
    line, other = sentence(rng, 30), sentence(rng, 30)
    edited = line.replace(line.split()[7], "changed", 1)
    rows = [(1, f"{line}\nshort\n{other}"), (2, f"short\n{edited}\n{line.upper()}"), (3, f"{line}\n{sentence(rng, 30)}"), (4, None), (5, ""), (None, line), (6, f"\t{line}  ")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0 and got[1]["n_lines"] == 2
    assert got[2]["text"] == "short" and got[2]["n_removed"] == 2
    assert got[3]["text"] == rows[2][1].split("\n")[1]
    assert got[4]["text"] is None and got[5]["text"] == "" and got[None]["text"] == line and got[6]["text"] == ""


def test_lines_have_few_bands_and_similar_lines_share_one(spark):
    """What a line costs in the shuffle of the bands, and that lines at the limit of similarity still meet."""
    rng = random.Random(12)
    pairs = []
    for k in range(400):
        words = sentence(rng, 6 + k % 50).split()
        edited = list(words)
        for _ in range(1 + len(words) // 14):
            edited[rng.randrange(len(edited))] = sentence(rng, 1)
        pairs.append((" ".join(words), " ".join(edited)))
    rows = [(2 * k + j, t, b"1") for k, p in enumerate(pairs) for j, t in enumerate(p)]
    lines = spark.createDataFrame(rows, "id long, norm string, digest binary").withColumn("w", F.split("norm", " "))
    bands = {r["id"]: set(r["bands"]) for r in line_dedup.with_bands(lines).collect()}
    several = 0
    for k, (x, y) in enumerate(pairs):
        a, b = ({t[j:j + 5] for j in range(len(t) - 4)} for t in (x, y))
        if len(a & b) >= 0.8 * len(a | b):
            assert bands[2 * k] & bands[2 * k + 1]
        for i, t in ((2 * k, x), (2 * k + 1, y)):
            items = len({(u, v[:line_dedup.NEXT]) for u, v in zip(t.split(), [*t.split()[1:], ""], strict=True)})
            wide = items < line_dedup.MANY or len(t) >= line_dedup.WIDE * items
            both = wide and items >= line_dedup.FEW and len(t) < line_dedup.WIDER * items
            several += not wide
            assert len(bands[i]) <= (line_dedup.WORDS - 1) * (both or not wide) + (line_dedup.CHARS - line_dedup.RUN + 1) * wide
    assert several > 300 and line_dedup.WORDS <= 10


def test_bands_are_dealt_out_once(spark):
    """The groups of a bucket and the join with its members read one shuffle by key, also if the members come from an aggregate."""
    rows = spark.range(3000).select((F.col("id") % 900).alias("digest"), F.struct("id").alias("c"))
    seen = []

    def confirm(pairs):
        seen.append(pairs)
        return pairs

    settled = common.settle
    plans = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(common, "settle", lambda df: plans.append(df) or settled(df))
        keyed = rows.groupBy("digest").agg(F.min("c").alias("c")).select("c", F.explode(F.array(F.col("digest") % 50, F.col("digest") % 70 + 1000)).alias("key"))
        common.bucket_links(keyed, confirm)
    stars = plans[0]
    stars.collect()
    assert "ReusedExchange" in stars._jdf.queryExecution().executedPlan().toString()


def test_bucket_rounds_find_every_link(spark):
    """All members meet in one bucket; links are a chain that no comparison with the smallest shows."""
    keyed = spark.range(200).select(F.lit(1).alias("key"), F.col("id").alias("c"))
    links = common.bucket_links(keyed, lambda p: p.where("b = a + 50"), pivots=8)
    got = {tuple(r) for r in common.components(links).collect()}
    assert got == {(i, i % 50) for i in range(200)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(49, 300), (7, 7)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[160] == 100 and got[300] == 1 and got[1] == 1 and 7 in got and len(got) == 61 + 49 + 1


def test_decontaminate(spark):
    rng = random.Random(6)
    items = [(k, sentence(rng, 8 + 7 * k)) for k in range(8)] + [(20, None), (21, ""), (22, "two words")]
    rows = [(k, sentence(rng, 400) + " " + t.upper() + " " + sentence(rng, 400)) for k, t in items[:8]]
    part = items[7][1].split()
    rows += [(30, sentence(rng, 50) + " " + " ".join(part[:50])), (31, " ".join(part[:20])), (32, None), (33, ""), (34, "two words"), (None, items[3][1]), (5, sentence(rng, 9))]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(8)} | {(30, 7), (34, 22)}


def test_mixing_meets_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").alias("source"), F.lit("t").alias("text"), F.lit(9).alias("copy"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 2.0), ("z", 0.0)], "source string, weight double")
    got = {r["source"]: r["count"] for r in mixing.mix(docs, weights).groupBy("source").count().collect()}
    assert abs(got["a"] - 5000) < 400 and abs(got["b"] - 5000) < 400 and abs(got[None] - 10_000) < 600
    many = mixing.mix(docs.limit(3).withColumn("source", F.lit("a")), spark.createDataFrame([("a", 1.0)], "source string, weight double"), total=6000.0).count()
    assert abs(many - 6000) < 600
    order = [r["shuffle_key"] for r in mixing.mix(docs, weights).select("shuffle_key").collect()]
    assert order == sorted(order)


def test_quality_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f g h " * 20), (None, "word " * 30), (4, "\n".join(["Same line here"] * 3 + ["last 1", "last 1 "]))]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, rows)).collect()}
    assert got[1]["base_failed"] and got[1]["n_words"] == 0 and got[2]["word_chars"] == 0
    assert got[3]["n_repeat_words"] == 160 and not got[3]["kept"] and got[4]["n_dup_lines"] == 2
    common_line = "this line is found in every text of the host"
    rng = random.Random(1)
    docs = frame(spark, [(k, common_line + "\n" + sentence(rng, 40 if k else 5)) for k in range(40)])
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    assert not kept[0] and all(kept[k] for k in range(1, 40))


def plain_lines(rows, percent=80, min_chars=30):
    """{(id, line number)} of the lines to remove, every pair compared."""
    lines = [((i, k), " ".join(x for x in line.lower().split(" ") if x)) for i, t in rows for k, line in enumerate(t.split("\n"))]
    sets = sorted((key, {x[j:j + 5] for j in range(len(x) - 4)}) for key, x in lines if len(x) >= min_chars)
    root = {key: key for key, _ in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key
    for (a, x), (b, y) in combinations(sets, 2):
        if 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {key for key in root if find(key) != key}


def test_lines_without_blanks_or_of_few_words(spark):
    rng = random.Random(6)
    han = [chr(0x4e00 + k) for k in range(600)]
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"

    def text(n, of=letters):
        return "".join(rng.choice(of) for _ in range(n))

    def edit(line, of=letters):
        k = rng.randrange(len(line))
        return line[:k] + rng.choice(of) + line[k + rng.randrange(2):]
    lines = []
    for n in (34, 60, 140, 400):
        for _ in range(6):
            a = text(n, han)
            lines += [a, edit(a, han), edit(edit(a, han), han), a + "\u3002"]
            b = "https://" + text(n)
            lines += [b, b + "/", edit(b), edit(edit(edit(b)))]
            lines.append(" ".join(a[k:k + 45] for k in range(0, n, 45)))  # the same with blanks
    for words in (2, 3, 4, 6, 11):
        for _ in range(6):
            w = [text(18) for _ in range(words)]
            a = " ".join(w)
            lines += [a, a + ".", "x" + a[1:], "x" + a[1:-1] + "!", edit(edit(a)), edit(a) + " " + text(3)]
    lines += ["abcd" * 12, "bcda" * 9 + "b", "a" * 40, "a" * 41, "ab" * 20 + "c"]
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[k * 4:k * 4 + 4])) for k in range(len(lines) // 4 + 1)]
    got = {(r["id"], r["line_no"]) for r in line_dedup.removed_lines(frame(spark, rows)).collect()}
    assert got == plain_lines(rows)


def test_only_near_pairs_are_compared(spark):
    """Pairs that their marks exclude reach no comparison, in no round; the links are those found without marks."""
    keyed = spark.range(40).select(F.lit(1).alias("key"), F.col("id").alias("c"))
    asked = []

    def confirm(pairs):
        asked.append({tuple(r) for r in pairs.collect()})
        return pairs.where("b = a + 20")

    links = common.bucket_links(keyed, confirm, pivots=8, describe=lambda members: members.select("c", (F.col("c") % 20).alias("mark")), near=lambda a, b: a == b)
    assert {tuple(r) for r in common.components(links).collect()} == {(i, i % 20) for i in range(40)}
    assert len(asked) > 1 and all(a % 20 == b % 20 for pairs in asked for a, b in pairs)


def test_marks_drop_no_similar_line(spark):
    """Lines at, above and below the similarity asked for, by a plain comparison of every pair."""
    rng = random.Random(11)
    rows = []
    for k in range(30):
        line = [rng.choice("abcdefghij") for _ in range(rng.choice([32, 60, 120, 400]))]
        rows.append((len(rows), "".join(line)))
        for edits in (1, 2, 3, len(line) // 40, len(line) // 20):
            for _ in range(edits):
                line[rng.randrange(len(line))] = rng.choice("klmnop")
            rows.append((len(rows), "".join(line)))
    sets = [{t[i:i + 5] for i in range(len(t) - 4)} for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r["id"] for r in line_dedup.removed_lines(frame(spark, rows)).collect()}
    assert got == {i for i in range(len(rows)) if root[i] != i} and len(got) > 30


def test_settled_tables_leave_no_shuffle(spark):
    """The shuffles of a written table are removed at once, not when the driver collects garbage; other queries keep theirs."""
    import time
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    shuffles = lambda: {w.split("_")[1] for w in kept().split() if w.startswith("shuffle_")}
    before = shuffles()
    common.settle(spark.range(1000).repartition(3).groupBy(F.col("id") % 7).count())
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and spark.conf.get(common.SHUFFLE_CLEANUP) == "false"
