"""Readers and writers on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from mosarea import schemas
from mosarea.functions import columns as C
from mosarea.operators import design as De, draws as Dr, frame as Fr, joins as J
from mosarea.sources import draws as Sd, tables as St


def test_csv_round_trip(spark, tmp_path):
    schema = T.StructType.fromDDL("k int, name string, x double, d date")
    df = spark.createDataFrame([(1, "a", 0.5, dt.date(2023, 5, 1)), (2, None, None, None)], schema)
    St.write_csv(df, str(tmp_path / "t"))
    back = St.read_csv(spark, str(tmp_path / "t"), schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_csv_header_must_match(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception):
        St.read_csv(spark, str(tmp_path / "x.csv"), T.StructType.fromDDL("a int, c int")).collect()


def test_bad_numbers_become_null_and_dates_are_cast(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,m\n1,2023-05-01\nNA,\noops,2024-05-01\n")
    df = St.read_csv(spark, str(tmp_path / "x.csv"), T.StructType.fromDDL("a int, m string"))
    rows = St.cast_dates(df, {"m": "yyyy-MM-dd"}).collect()
    assert [r.a for r in rows] == [1, None, None]
    assert [r.m for r in rows] == [dt.date(2023, 5, 1), None, dt.date(2024, 5, 1)]


def test_partitioned_table(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("obs_month"))
    St.write_table(df, str(tmp_path / "t"), ["obs_month"])
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["obs_month=0", "obs_month=1", "obs_month=2"]
    assert St.read_table(spark, str(tmp_path / "t")).where("obs_month = 1").count() == 33


def test_margins_json_and_parquet(spark, tmp_path):
    margins = Fr.census_margins(spark)
    St.write_margins(margins, str(tmp_path))
    from_json = spark.read.schema(schemas.MARGINS).json(str(tmp_path / "json"))
    from_parquet = St.read_table(spark, str(tmp_path / "parquet"))
    assert sorted(from_json.collect()) == sorted(from_parquet.select(*from_json.columns).collect())
    water = margins.where("var = 'h_water_source_2way'").agg(F.sum("freq")).first()[0]
    assert water == pytest.approx(0.999)


CHAIN = """# sampler settings
# more
lp__,accept_stat__,b0,betas.1,betas.2,psi.1.1,psi.2.1
-1,0.9,10,20,30,40,50
-2,0.8,11,21,31,41,51
# adaptation finished
-3,0.7,12,22,32,42,52
-4,0.6,13,23,33,43,53
# elapsed
"""
HEADER = "lp__ accept_stat__ b0 betas.1 betas.2 psi.1.1 psi.2.1".split()


def test_chain_files(spark, tmp_path):
    chains = []
    for k in (1, 2):
        path = tmp_path / f"chain-{k}.csv"
        path.write_text(CHAIN)
        chains.append(Sd.read_chain_csv(spark, str(path), k, HEADER, warmup=2))
    draws = Sd.combine_chains(*chains)
    assert draws.columns == ["chain", "iteration", "draw", "param", "i", "j", "value"]
    assert sorted(r.draw for r in draws.select("draw").distinct().collect()) == [1, 2, 3, 4]
    got = {(r.draw, r.param, r.i, r.j): r.value for r in draws.collect()}
    assert got[(1, "b0", None, None)] == 12 and got[(2, "b0", None, None)] == 13 and got[(3, "b0", None, None)] == 12
    assert got[(2, "psi", 2, 1)] == 53 and got[(1, "betas", 2, None)] == 32
    assert len(got) == 4 * 5
    only = Sd.read_chain_csv(spark, str(tmp_path / "chain-1.csv"), 1, HEADER, warmup=0, keep=("b0",))
    assert only.count() == 4
    assert Sd.without_warmup(only, 2).count() == 2
    summary = {r.name: r.mean for r in Dr.parameter_summary(Dr.named_parameters(draws, ("b0", "betas"), ["u", "v"])).collect()}
    assert summary == {"Intercept": 12.5, "u": 22.5, "v": 32.5}
    assert Dr.chain_summary(Dr.named_parameters(draws, ("b0",), [])).count() == 2


def test_chains_in_one_reading(spark, tmp_path):
    """Chains by file name, iterations by line, whatever the tasks read; unequal chains are an error."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for chain in (1, 2, 3):
        lines = "\n".join(f"{-k},0.5,{chain * 1000 + k},2,3,4,5" for k in range(200))
        (tmp_path / f"chain-{chain}.csv").write_text("# settings\n" + ",".join(HEADER) + "\n" + lines + "\n# elapsed\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        draws = Sd.read_chains(spark, str(tmp_path), HEADER, warmup=50, keep=("b0",))
        rows = draws.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.chain, r.iteration, r.draw): r.value for r in rows} == {(c, k, (c - 1) * 150 + k): c * 1000 + 49 + k for c in (1, 2, 3) for k in range(1, 151)}
    (tmp_path / "chain-3.csv").write_text(",".join(HEADER) + "\n" + "\n".join("1,1,1,1,1,1,1" for _ in range(60)) + "\n")
    with pytest.raises(Exception, match="different length"):
        Sd.read_chains(spark, str(tmp_path), HEADER, warmup=50).collect()


def test_row_numbers_follow_the_file(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("v\n" + "\n".join(str(k) for k in range(20000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = spark.read.schema("v int").option("header", True).csv(str(path))
        numbered = Sd.number_in_file_order(df, "row")
        assert numbered.where(F.col("row") != F.col("v") + 1).count() == 0
        assert numbered.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_prevalence_sink_and_wide_form(spark, tmp_path):
    rows = [(a, t, d, a + t / 10 + d / 100, 0.0) for a in (1, 2) for t in (1, 2) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, schemas.PREVALENCE)
    St.write_prevalence(df, str(tmp_path / "p"), "joint", "mrp")
    back = St.read_table(spark, str(tmp_path / "p")).where("month_idx = 2")
    assert back.count() == 6 and back.first().model == "joint"
    wide = St.prevalence_wide(df, "prev", [1, 2, 3])
    assert wide.columns == ["adm2_index", "month_idx", "V1", "V2", "V3"]
    assert sorted(St.prevalence_long(wide).collect()) == sorted(df.select("adm2_index", "month_idx", "draw", "prev").collect())


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A B` int, fcs_x int, c int")
    assert C.rename_by_function(df, C.snake_case).columns == ["a_b", "fcs_x", "c"]
    assert C.rename_by_position(df, 1, ["p", "q"]).columns == ["A B", "p", "q"]
    assert C.drop_prefixed(df, "fcs_").columns == ["A B", "c"]
    assert C.shared_columns(df, df.select("c", "fcs_x"), ["c"]) == ["fcs_x"]
    indexed = spark.createDataFrame([(1, 2)], "`psi[1,2]` int, `wilson_low80` int")
    assert C.rename_by_pattern(indexed, (r"\[|\]", ""), (",", "_"), ("wilson_", "")).columns == ["psi1_2", "low80"]
    with pytest.raises(ValueError):
        C.rename_by_map(df, {"nope": "x"})
    with pytest.raises(ValueError):
        De.covariates("phone")
    assert len(De.covariates("joint")) == 20 and len(De.covariates("phone_only")) == 10


def test_score_join_fans_out(spark):
    survey = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, respondent_id string")
    scores = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", 0.4)], "respondent_id string, p_cell double")
    assert J.left_join(survey, scores, ["respondent_id"]).count() == 7
    assert [tuple(r) for r in J.duplicate_keys(scores, "respondent_id").collect()] == [("a", 3)]


def test_settled_dimension_keeps_rows_and_types(spark):
    """Sent to joins within the session's broadcast limit, joined by shuffle beyond it; the same rows either way."""
    df = spark.range(50).selectExpr("id", "cast(id as string) as name", "cast(null as date) as day")
    other = spark.range(20).selectExpr("id", "id + 1 as more")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (limit, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            settled = St.settle_dimension(df)
            assert settled.schema == df.schema and sorted(settled.collect()) == sorted(df.collect())
            plan = other.join(settled, "id")._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (threshold != "-1")
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
