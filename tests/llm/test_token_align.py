"""Alignment of tokens against a plain version made from the definitions."""

import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from ordinalis.llm import token_align as ta
from ordinalis.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", " ", "  two  spaces ", "tab\tand\r\nlines\n\n", "▁ marked", "<|endoftext|> <s> </s> <unk> <0x41>", "中文没有空格的一行文字",
       "naïve café 🙂🙃 \u0000 end", "é  x　y", "x" * 3000, "word " * 3000, "a", "<unk>", "﻿bom", "ﬁ ligature Ⅷ"]


def plain(texts):
    a_model = Tokenizer.from_file(f"{ta.FOLDER}/{ta.BYTE_BPE}")
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=f"{ta.FOLDER}/{ta.PIECES}")
    alphabet = ta.byte_alphabet()
    docs = []
    for t in texts:
        data = (" " + (t or "")).encode()
        a = a_model.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        wa = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        wb = [bytes([int(p[3:-1], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_model.id_to_piece, b))]
        if b"".join(wa) != data or b"".join(wb) != data:
            docs.append(([], [], [], []))
            continue
        ends = lambda words: [sum(map(len, words[:k + 1])) for k in range(len(words))] if len(words) < 400 else running(words)
        ea, eb = ends(wa), ends(wb)
        cuts, groups, la, lb = sorted(set(ea) & set(eb)), [], 0, 0
        links = []
        for c in cuts:
            na, nb = ea.index(c, la) + 1, eb.index(c, lb) + 1
            groups.append((a[la:na], b[lb:nb]))
            links.append((a[na - 1], b[nb - 1]))
            la, lb = na, nb
        docs.append((a, b, groups, links))
    n = Counter(p for d in docs for p in d[3])
    best = {}
    for (_, b), k in n.items():
        best[b] = max(best.get(b, 0), k)
    rows = []
    for a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(n[p] == best[p[1]] for p in links), sum(n[p] for p in links),
                     hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return rows


def running(words):
    out, at = [], 0
    for w in words:
        at += len(w)
        out.append(at)
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_query_equals_plain(spark, monkeypatch, tmp_path, few):
    """Whole documents and odd ones, with the pairs broadcast and joined by a shuffle."""
    monkeypatch.setattr(ta, "FEW_PAIRS", few)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame([(*d, "a", 1, 2, 3) for d in docs], "doc_id long, text string, of string, row int, pair int, links int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_token_align"](spark, str(tmp_path)).collect()}
    assert got == dict(zip([d[0] for d in docs], plain([d[1] for d in docs]), strict=True))
    zero = (0, 0, 0, 0, 0, 0, "")
    assert got[10_000] == got[10_001] == got[10_006] == zero and got[10_002] == got[10_013] != zero


def test_windows_do_not_matter(monkeypatch):
    """Windows split at anchors give the groups of the whole text, remembered or not."""
    aligner = ta.Aligner(f"{ta.FOLDER}/{ta.BYTE_BPE}", f"{ta.FOLDER}/{ta.PIECES}")
    texts = [t for t in ODD if t] + ["Der schnelle Fuchs springt über den faulen Hund, das war's. " * 5]
    for t, a, b in zip(texts, aligner.a.encode(texts), aligner.b.encode(texts)):
        found = aligner.align(t, a, b)
        if found[0]:
            whole = ta.align_window(a, b, aligner.a.vocabulary, aligner.b.vocabulary)
            assert (found[3], found[4]) == whole and found[2] == len(found[4]) // 8 == found[3].count("|")
    monkeypatch.setattr(ta, "MEMO_SIZE", 2)
    again = ta.Aligner(f"{ta.FOLDER}/{ta.BYTE_BPE}", f"{ta.FOLDER}/{ta.PIECES}")
    t = texts[-1]
    assert again.align(t, *again.a.encode([t]), *again.b.encode([t])) == aligner.align(t, *aligner.a.encode([t]), *aligner.b.encode([t]))
    assert len(again.memo) <= 2


def test_merges_by_rank_equal_the_file():
    """Both ways of the byte-level side give the same ids, on documents and on strings of awkward characters."""
    side = ta.ByteLevel(f"{ta.FOLDER}/{ta.BYTE_BPE}")
    assert side.fast is not None
    rng = random.Random(5)
    alphabet = "aaabbeeinst  \n\t\r\r.,'!?019éßñÅ¡½ª²­–—“…‧sdmtlvr"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(4000)] + [t for t in ODD if t]
    want = [e.ids for e in side.model.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert side.encode(texts) == want and sum(ta._COMMON.fullmatch(t) is not None for t in texts) >= 4000
    broken = json.loads(side.model.to_str())
    broken["model"]["merges"][0], broken["model"]["merges"][1] = broken["model"]["merges"][1], broken["model"]["merges"][0]
    assert side.ranked(broken, {w: i for w, i in side.model.get_vocab(with_added_tokens=False).items()}) is None


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = ta.link_counts(ta.align_tokens(df)).collect()
    assert len(rows) == 3 and {r["count_sum"] for r in rows} == {6} and {r["n_best"] for r in rows} == {2}
    assert ta.link_counts(ta.align_tokens(df.limit(0))).count() == 0
