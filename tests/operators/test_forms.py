import hashlib
import os

from pyspark.sql import functions as F

from driftloom.operators import evaluate
from driftloom.sources.forms import FormTable

FIELDS = "id long, label string, note string"


def table(spark, tmp_path, buckets=32):
    return FormTable(spark, f"file://{tmp_path}/forms", "id", FIELDS, buckets)


def ids(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "id long")


def rows(frame):
    return sorted((r.id, r.label, r.note) for r in frame.collect())


def test_upserts_equal_a_dictionary(spark, tmp_path):
    forms, plain = table(spark, tmp_path), {}
    assert rows(forms.read()) == []
    for new, filled in (([1, 2, 2, None], []), (range(200), [(2, "a", None), (900, "b", "n")]), ([], [(2, "c", "m")]), ([5, 900], [])):
        forms.ensure(ids(spark, new))
        for n in new:
            if n is not None:
                plain.setdefault(n, (None, None))
        if filled:
            forms.put(spark.createDataFrame(filled, FIELDS))
            plain |= {i: (a, b) for i, a, b in filled}
        assert rows(forms.read()) == sorted((i, *v) for i, v in plain.items())
    assert rows(table(spark, tmp_path).read()) == sorted((i, *v) for i, v in plain.items())


def test_a_delta_touches_only_its_buckets(spark, tmp_path):
    forms = table(spark, tmp_path)
    forms.ensure(ids(spark, range(2000)))

    def stamps():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "forms") for f in names if f.endswith(".parquet")}

    before = stamps()
    delta = spark.createDataFrame([(7, "x", None), (8, "y", None)], FIELDS)
    of = {r[0] for r in forms._filed(delta).select("_bucket").collect()}
    met = forms.read(delta)
    assert {f"_bucket={b}" for b in of} == {r[0].split("/")[-2] for r in met.select("_metadata.file_path").distinct().collect()}
    assert "PartitionFilters: [isnotnull(_bucket" in (plan := met._jdf.queryExecution().toString()) or "PartitionFilters: [_bucket" in plan
    forms.put(delta)
    gone = {p.split("/")[-2] for p in before.keys() - stamps().keys()}
    assert gone == {f"_bucket={b}" for b in of} and len(of) <= 2
    between = stamps()
    forms.ensure(ids(spark, [7, 8, 100_000]))
    assert len(stamps().keys() - between.keys()) == 1 and between.items() <= stamps().items()
    assert forms.read().count() == 2001


def test_pieces_of_a_large_stratum_are_small_and_dealt_in_turn(spark, monkeypatch):
    items = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 100 == 0, "small").when(F.col("id") % 1000 == 1, None).otherwise("large").alias("s"))
    taken = items.where("id < 50").select("id")
    split = {r.id: r.part for r in evaluate.balanced_split(items, taken, "id", ["s"], parts=3, most=200).collect()}
    lot = lambda i: hashlib.md5(f"1|{i}".encode()).hexdigest()
    of = {r.id: r.s for r in items.collect()}
    order = sorted((i for i in of if i >= 50), key=lambda i: (of[i] is not None, of[i] or "", lot(i)))
    assert split == {i: n % 3 for n, i in enumerate(order)}
    plan = evaluate.balanced_split(items, taken, "id", ["s"], most=200)
    assert plan.count() == 19_950
