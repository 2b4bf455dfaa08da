import warnings

import pytest
from pyspark.sql import functions as F

from ordinalis.operators import assoc, prep
from ordinalis.session import scratch_path
from ordinalis.sources import sinks, tables

KEY = "Customer ID"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_merge_adds_only_new_columns_widest_first(spark):
    a = frame(spark, [(1, "x", "z1"), (2, "y", "z2")], "`Customer ID` int, A string, `Zip Code` string")
    b = frame(spark, [(1, "other", 5, 6, 7), (3, "q", 8, 9, 1)], "`Customer ID` int, A string, B int, C int, D int")
    z = frame(spark, [("z1", 100)], "`Zip Code` string, Population int")
    lost = frame(spark, [(1,)], "Q int")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = tables.merge_tables({"a": a, "b": b, "z": z, "lost": lost}, KEY, "Zip Code")
    assert any("lost" in str(w.message) for w in seen)
    assert out.columns == ["Zip Code", KEY, "A", "B", "C", "D", "Population"]
    got = {r[KEY]: r for r in out.collect()}
    assert set(got) == {1, 3} and got[1].A == "other" and got[1].Population == 100 and got[3]["Zip Code"] is None


def test_merge_needs_a_key(spark):
    with pytest.raises(ValueError, match="Customer ID"):
        tables.merge_tables({"z": frame(spark, [(1,)], "Q int")}, KEY)


def test_names_types_and_required_columns(spark):
    df = frame(spark, [("7", " 1.5 "), ("8", "x"), ("9", "")], "customerID string, `TotalCharges ` string")
    out = tables.coerce_numeric(tables.normalize_columns(df), ["Total Charges", "absent"])
    assert out.columns == [KEY, "Total Charges"]
    assert [r["Total Charges"] for r in out.collect()] == [1.5, None, None]
    with pytest.raises(ValueError, match="Satisfaction Score"):
        tables.require_columns(out, ["Satisfaction Score"])


def test_layout(spark, tmp_path):
    spark.range(3).coalesce(1).write.option("header", True).csv(str(tmp_path / "d"))
    (part,) = (tmp_path / "d").glob("part-*.csv")
    folder = tmp_path / "raw"
    folder.mkdir()
    part.rename(folder / "b.csv")
    (folder / "a.csv").write_text("id\n1\n")
    got = {r.name: (r.layout, r.used) for r in tables.scan_layout(tables.list_tables(spark, str(folder))).collect()}
    assert got == {"a": ("csv", True), "b": ("csv", False)}
    got = {r.name: (r.n_files, r.n_rows, r.n_columns) for r in tables.scan_contents(spark, f"{folder}/").collect()}
    assert got == {"a": (1, 1, 1), "b": (1, None, None)}
    assert tables.load_tables(spark, {"b": str(folder / "b.csv")})["b"].count() == 3
    with pytest.raises(ValueError):
        tables.load_tables(spark, {"x": "x.xlsx"})


def test_scan_of_tables_in_many_files(spark, tmp_path):
    """Tables are folders of files that differ in columns; hidden files and unknown formats do not count."""
    folder = tmp_path / "a b+c"
    spark.range(5).repartition(2).write.parquet(f"{folder}/wide.parquet")
    spark.range(3).withColumn("x", F.lit(1)).coalesce(1).write.mode("append").parquet(f"{folder}/wide.parquet")
    spark.range(0).write.parquet(f"{folder}/empty.parquet")
    (folder / "notes.txt").write_text("x")
    (folder / ".draft.parquet").write_text("x")
    got = {r.name: (r.format, r.n_files, r.layout, r.used, r.n_rows, r.n_columns) for r in tables.scan_contents(spark, str(folder)).collect()}
    assert got == {"wide": ("parquet", 3, "multi", True, 8, 2), "empty": ("parquet", 1, "multi", True, 0, 1)}


def test_targets(spark):
    df = frame(spark, [(1,), (2,), (3,), (4,), (5,), (None,)], "`Satisfaction Score` int")
    out = prep.add_all_targets(df)
    assert [r.NPS_baseline for r in out.collect()] == ["Detractor"] * 3 + ["Passive", "Promoter", None]
    assert [r.NPS_alternative for r in out.collect()] == ["Detractor"] * 2 + ["Passive"] * 2 + ["Promoter", None]
    prep.assert_mapped(df)
    with pytest.raises(ValueError, match="9"):
        prep.assert_mapped(frame(spark, [(9,)], "`Satisfaction Score` int"))
    with pytest.raises(ValueError):
        prep.build_target(df, "none")
    table = {(r.mapping, r["class"]): r for r in prep.summarise_mappings(out.filter("NPS_baseline = 'Detractor'"), ["baseline"]).collect()}
    assert table[("baseline", "Detractor")].pct == 100.0 and table[("baseline", "Promoter")].n == 0


def raw(spark, n=60):
    i = F.col("id")
    return spark.range(n).select(
        i.alias(KEY), (i % 5 + 1).cast("int").alias("Satisfaction Score"), (i % 7).cast("int").alias("Tenure Months"),
        (i * 1.5).alias("Monthly Charges"), F.when(i % 10 != 0, i * 2.0).alias("Total Charges"),
        F.when(i % 3 != 0, "Fiber").alias("Internet Type"), F.lit("US").alias("Country"), (i % 5 * 10).alias("CLTV"))


def test_dataset_and_validation(spark):
    out = prep.build_dataset(raw(spark))
    assert "CLTV" not in out.columns and "Country" not in out.columns and "Satisfaction Score" not in out.columns
    checks = {r.check: r.passed for r in prep.validate_dataset(out, min_rows=60, min_columns=6).collect()}
    assert all(checks.values()), checks
    with pytest.raises(ValueError, match="min_rows"):
        prep.assert_valid(out)
    bad = {r.check: r.passed for r in prep.validate_dataset(raw(spark).union(raw(spark))).collect()}
    assert not bad["no_leak_columns"] and not bad["unique_key"] and not bad["target_present:NPS_baseline"]
    report = {r.column: r.n_imputed for r in prep.imputation_report(raw(spark), ["Total Charges", "Internet Type", "absent"]).collect()}
    assert report == {"Total Charges": 6, "Internet Type": 20}
    assert {r.outcome for r in prep.drop_report(raw(spark)).collect()} == {"dropped", "not_in_data"}
    meta = prep.build_metadata(raw(spark), out, ["Total Charges"]).first()
    assert meta.n_rows == 60 and meta.imputations == {"Total Charges": 6} and meta.score_maps["baseline"]["4"] == "Passive"


def test_profiles(spark):
    exact = {r.column: (r.n_unique, r.n_null) for r in prep.profile_columns(raw(spark)).collect()}
    rough = {r.column: (r.n_unique, r.n_null) for r in prep.profile_columns(raw(spark), exact=False).collect()}
    assert exact["Country"] == (1, 0) and exact["Internet Type"] == (1, 20) and exact["Total Charges"] == (54, 6)
    assert {k: v[1] for k, v in rough.items()} == {k: v[1] for k, v in exact.items()}
    assert {r.column for r in prep.constant_columns(raw(spark)).collect()} == {"Country"}
    assert {r.column: r.n_missing for r in prep.missing_report(raw(spark)).collect()} == {"Total Charges": 6, "Internet Type": 20}


def test_get_split(spark):
    data = prep.build_dataset(raw(spark))
    splits = data.select(KEY, F.when(F.col(f"`{KEY}`") < 10, "train").otherwise("test").alias("split"))
    out = prep.get_split(data, splits, "train", "NPS_baseline")
    assert out.count() == 10 and "y" in out.columns and not [x for x in out.columns if x.startswith("NPS_")]
    with pytest.raises(ValueError):
        prep.get_split(data, splits, "val", "NPS_baseline")


def test_sinks(spark):
    df = spark.range(5).select("id", F.lit("a").alias("split"))
    path = scratch_path(spark, "t")
    sinks.save_splits(df, "one", path)
    sinks.save_splits(df.limit(2), "two", path)
    sinks.save_splits(df.limit(3), "two", path)
    assert sinks.load_splits(spark, "one", path).count() == 5 and sinks.load_splits(spark, "two", path).count() == 3
    assert sinks.inventory(spark, ["x"], {}).first().present is False


def test_leak_audit_verdicts(spark):
    i = F.col("id")
    df = spark.range(200).select((i % 5).cast("double").alias("t"), (i % 5 * 2).cast("double").alias("twin"), ((i * 37) % 11).cast("double").alias("noise"),
                                 F.lit(1.0).alias("flat"), i.cast("string").alias("key"), F.when(i % 5 < 2, "low").otherwise("high").alias("band"))
    audit = {r.feature: r for r in assoc.leak_audit(df, "t", ("noise",)).collect()}
    assert audit["twin"].verdict == "STRONG LEAK" and audit["twin"].spearman_r == 1.0
    assert audit["noise"].verdict == "CONFIGURED" and audit["flat"].score == 0.0 and audit["flat"].spearman_r is None
    assert audit["key"].eta_squared == 1.0 and audit["key"].is_key_like and not audit["band"].is_key_like
    summary = {r.verdict: r.features for r in assoc.leak_summary(assoc.leak_audit(df, "t", ("noise",))).collect()}
    assert summary["STRONG LEAK"] == ["band", "key", "twin"] and summary["WEAK LEAK"] == [] and summary["CONFIGURED BUT MILD"] == ["noise"]


def test_spearman_with_ties_and_nulls(spark, distributed):
    import pandas as pd
    rows = [(float(i % 4), float((i * 7) % 5) if i % 6 else None) for i in range(60)]
    got = assoc.spearman(spark.createDataFrame(rows, "t double, x double"), ["x"], "t").first().spearman_r
    pdf = pd.DataFrame(rows, columns=["t", "x"]).dropna()
    assert got == pytest.approx(pdf.t.rank().corr(pdf.x.rank()))


def test_share_of_a_short_call_list(spark):
    df = frame(spark, [(i, "a" if i < 3 else "b", i / 10) for i in range(10)], "id int, seg string, p double")
    got = prep.cohort(df, {"seg": "a"}, "p", 5, "id").collect()
    assert [r.id for r in got] == [2, 1, 0] and {r.pct_of_population for r in got} == {30.0}
    assert {r.pct_of_population for r in prep.cohort(df, {"seg": "b"}, "p", 5, "id").collect()} == {50.0}
    assert prep.cohort(df, {"seg": "none"}, "p", 5, "id").count() == 0
