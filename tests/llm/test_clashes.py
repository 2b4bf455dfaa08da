"""Every operator on documents whose extra columns have the names that operators use inside."""

import pytest
from pyspark.sql import functions as F

from ordinalis.llm import decontaminate, hard_negatives, html_text, langid, line_dedup, lm_score, mixing, near_dup, pii, quality, suffix_dedup, token_align, toxicity

INSIDE = ("a at b best block c class component copy count doc doc_of docs f found freq group grp h hash hits host i id item item_id items j k key kind label "
          "line line_no lines m n n_item n_shared n_shingles n_words nb node nos of p pair parts picked piece place pos r rank rate rep rid root row s score "
          "shingle shuffle_key sig size slot some spans tag text_hash u v vec w wanted word x y").split()


@pytest.fixture
def docs(spark):
    words = "the lazy fox jumps over a sleeping dog near the old river bank while seven birds sing in the tall green trees above".split()
    texts = [" ".join(words), " ".join(words), " ".join(words[:-1]) + " below", "\n".join([" ".join(words)] * 2), "", None, "ein anderer Text mit Wörtern " * 9]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(INSIDE)])


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op12", "op13"])
def test_clashing_columns(spark, docs, name):
    labels = docs.select("doc_id", F.lit(0).alias("toxic"), *INSIDE)
    bench = docs.drop("item_id").select(F.col("doc_id").alias("item_id"), "text", *[c for c in INSIDE if c not in ("item_id", "copy")])
    run = {"op1": lambda: suffix_dedup.repeated_bytes(docs), "op2": lambda: pii.find_pii(docs), "op3": lambda: line_dedup.dedup_lines(docs),
           "op4": lambda: toxicity.toxicity(docs, labels), "op5": lambda: decontaminate.contaminated(docs, bench), "op6": lambda: near_dup.near_duplicates(docs),
           "op7": lambda: lm_score.lm_scores(docs, docs.where("doc_id < 3").select("doc_id")), "op8": lambda: langid.identify(docs, per_language=3),
           "op9": lambda: quality.quality(docs), "op10": lambda: mixing.mix(docs.drop("copy", "shuffle_key"), mixing.temperature_weights(docs)),
           "op12": lambda: html_text.extract_text(docs, page_id="doc_id", url="lang", html="text"), "op13": lambda: token_align.link_counts(token_align.align_tokens(docs))}
    rows = run[name]().collect()
    assert rows if name in ("op5", "op10") else len(rows) == 7


def test_hard_negatives_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i % 7) + 1, float(i % 3)]) for i in range(120)], "vec_id long, label int, embedding array<double>")
    wide = df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(INSIDE) if n != "label"])
    plain, clash = (sorted(map(tuple, hard_negatives.hard_negatives(x, F.col("vec_id") % 100 == 0).collect())) for x in (df, wide))
    assert plain == clash and plain
