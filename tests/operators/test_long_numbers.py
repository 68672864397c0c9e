"""Numbers that no 64 bits hold are forged as the SQL does it."""

from driftloom.plans import oracle, queries
from tests.compare import difference

NUMBERS = [
    "7", "4.9", "1,25", "9007199254740992.7", "9007199254740993", "9223372036854775807", "9223372036854775808", "9999999999999999999", "18446744073709551616",
    "12345678901234567890", "99999999999999999999.5", "100000000000000000000", "12500000000000000000", "33333333333333333333333", "20999999999999999999999999999999999999",
]


def test_forged_numbers_of_any_length_match_sql(spark, tmp_path):
    rows = [(k * 100 + i, f"It took {n} of 20.") for i, n in enumerate(NUMBERS) for k in range(6)]
    spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert difference(spark, str(tmp_path), queries.inject_numeric, oracle.SQL["inject_numeric"]) is None


def test_numbers_beyond_sql_fail_no_job(spark, tmp_path):
    spark.createDataFrame([(i, "9" * n) for i, n in enumerate((38, 39, 320))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.inject_numeric(spark, str(tmp_path)).where("injected_md5 is not null").count() == 3
