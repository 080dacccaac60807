"""Stage files, document passages, and the scratch folder."""

from pyspark.sql import functions as F

from callweave.operators import documents, eligibility
from callweave.plans.scratch import materialise
from callweave.sources import stages

SCHEMA = "id string, source string, n int, tags array<string>"


def test_stage_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "s", 1, ["x", "y"]), ("b", "t", None, None)], SCHEMA)
    stages.write_stage(df, str(tmp_path / "j"))
    assert sorted(stages.read_stage(spark, str(tmp_path / "j"), SCHEMA).collect()) == sorted(df.collect())
    assert stages.read_stage(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_flat_csv_round_trip(spark, tmp_path):
    rows = [("a", 'quote " and, comma\nline', 1, ["x", "y"]), ("b", "", 2, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    stages.export_csv(df, str(tmp_path / "c"))
    assert sorted(stages.import_csv(spark, str(tmp_path / "c"), df.schema, keep_empty=("source",)).collect()) == sorted(df.collect())
    assert stages.import_csv(spark, str(tmp_path / "c"), df.schema).where("source is null").count() == 1


def test_last_review_wins(spark):
    df = spark.createDataFrame([("t", "AGE", "drop", None, '{"max_age": 30}', None, 1), ("t", "AGE", "fix", "REQUIRES", '{"max_age": 35}', None, 2)], "text string, label string, decision string, polarity string, value string, scope string, pos int")
    (row,) = stages.typed_reviews(df, "pos").collect()
    assert (row.decision, row.value.max_age, row.scope) == ("fix", 35, "APPLICANT")


def test_passages_stay_within_a_heading(spark):
    text = "# One\n" + "a b c. " * 60 + "\nmore\n\n# Two\nlast"
    lines = documents.line_table(spark.createDataFrame([(1, text)], "k bigint, t string"), "k", "t")
    packed = documents.pack_lines(documents.with_section(lines, F.col("marked")), most=100).orderBy("chunk_index").collect()
    assert all(len(r.chunk) <= 101 for r in packed) and [r.section for r in packed][-1] == "Two" and "last" in packed[-1].chunk
    assert sum(r.chunk.count("a b c.") for r in packed) == 60


def test_evidence_is_asked_for(spark):
    p = spark.createDataFrame([(1, 0, "Born in  Rome, 1980")], "key int, chunk_index int, chunk string")
    df = spark.createDataFrame([(1, 0, "born in rome", "Rome"), (1, 0, "Paris", "Paris"), (1, 9, "x", "y"), (1, 0, "1980", " ")], "key int, chunk_index int, quote string, value string")
    assert sorted(str(r.reason) for r in documents.evidence(df, p).collect()) == ["None", "no passage", "no value", "not quoted"]


def test_languages_and_favour(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one.select(eligibility.languages_met(arr("de", "en"), arr("en"))).first()[0] is True
    assert one.select(eligibility.languages_met(F.array().cast("array<string>"), arr("en"))).first()[0] is None
    assert one.select(eligibility.in_favour(arr("AGE", "GENERIC"), F.lit("AGE"), F.lit("REQUIRES"), F.lit(True))).first()[0] == "PASS"
    assert one.select(eligibility.in_favour(arr("AGE", "RESIDENCE"), F.lit("AGE"), F.lit("REQUIRES"), F.lit(True))).first()[0] == "CHECK"


def test_materialised_tables_keep_their_schema(spark):
    df = spark.createDataFrame([(1, [1.5], None)], "a int, b array<double>, c string")
    again = materialise(df, "t")
    assert again.collect() == df.collect() and [(f.name, f.dataType) for f in again.schema] == [(f.name, f.dataType) for f in df.schema]
