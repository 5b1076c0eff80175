"""Delimited scans, table replacement, batch append and the shared folder."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources import (
    append_batch,
    load_raw,
    materialise,
    read_delimited,
    register_bronze,
    replace_table,
    shared_folder,
    stored,
)
from tidemark.sources import shared

HEADER = "customer_id|first_name|last_name|email|mobile|gender|date_of_birth|signup_date"


@pytest.fixture
def chunks(tmp_path):
    for i in (1, 2):
        line = f"{i}| A|B|e{i}@x.y|0917{i}|Male|1990-02-0{i}|2020-01-01"
        (tmp_path / f"part{i}.csv").write_text(f"{HEADER}\n{line}\n")
    return str(tmp_path)


def unique(name):
    return f"{name}_{uuid.uuid4().hex}"


def test_glob_keeps_leading_zeros_and_blanks(spark, chunks):
    df = read_delimited(spark, f"{chunks}/part*.csv", schemas.CUSTOMERS)
    got = {r.customer_id: r for r in df.collect()}
    assert set(got) == {1, 2}
    assert got[1].mobile == "09171" and got[1].first_name == " A"
    assert got[2].date_of_birth == dt.date(1990, 2, 2)


def test_inference_is_opt_in_and_loses_the_zero(spark, chunks):
    df = read_delimited(spark, f"{chunks}/part*.csv", None)
    assert df.schema["mobile"].dataType.typeName() in ("integer", "long")


def test_options_pass_through(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text("product_id;customer_id;product_type;enrollment_date;limit\n1;2;'a;b';2020-01-01;NA\n")
    df = read_delimited(spark, str(path), schemas.ENROLLMENTS, sep=";", quote="'", nullValue="NA")
    row = df.first()
    assert (row.product_type, row["limit"]) == ("a;b", None)


def test_header_must_match_the_schema(spark, tmp_path):
    path = tmp_path / "swapped.csv"
    path.write_text("customer_id|product_id|product_type|enrollment_date|limit\n1|2|a|2020-01-01|0\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_delimited(spark, str(path), schemas.ENROLLMENTS).collect()


def test_load_stamps_every_row(spark, chunks):
    name = unique("customer_raw")
    now = dt.datetime(2024, 1, 2, 3)
    load_raw(spark, f"{chunks}/*.csv", name, schemas.CUSTOMERS, now)
    assert {r[0] for r in spark.table(name).select("_ingested_at").collect()} == {now}
    load_raw(spark, f"{chunks}/part1.csv", name, schemas.CUSTOMERS)
    assert spark.table(name).count() == 1


def test_replacement_may_read_itself_and_change_schema(spark):
    name = unique("t")
    replace_table(spark.range(5), name)
    reader = spark.table(name)
    replace_table(spark.table(name).where("id > 2").withColumn("twice", F.col("id") * 2), name)
    assert {tuple(r) for r in spark.table(name).collect()} == {(3, 6), (4, 8)}
    assert reader.count() == 5, "a running reader keeps the content it started with"
    for _ in range(3):
        replace_table(spark.table(name).where("id = 4"), name)
    assert spark.table(name).count() == 1
    kept = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}__")]
    assert sorted(kept) == [f"{name}__g4", f"{name}__g5"]


def test_failed_replacement_leaves_the_table(spark):
    name = unique("t")
    replace_table(spark.range(5), name)
    with pytest.raises(Exception):
        replace_table(spark.range(5).select(F.raise_error(F.lit("lost")).alias("id")), name)
    assert spark.table(name).count() == 5
    replace_table(spark.range(7), name)
    assert spark.table(name).count() == 7


def test_plain_tables_are_not_replaced(spark):
    name = unique("t")
    spark.range(3).write.saveAsTable(name)
    with pytest.raises(ValueError):
        replace_table(spark.range(5), name)
    assert spark.table(name).count() == 3


def test_append_goes_to_the_live_table(spark):
    name = unique("t")
    append_batch(spark.range(2), name)
    append_batch(spark.range(3), name)
    assert spark.table(name).count() == stored(spark, name).count() == 5
    replace_table(spark.table(name).distinct(), name)
    append_batch(spark.range(1), name)
    assert spark.table(name).count() == 4


def test_bronze_view_is_a_pass_through(spark):
    name = unique("t")
    replace_table(spark.range(2), name)
    register_bronze(spark, {f"bronze_{name}": name})
    assert spark.table(f"bronze_{name}").columns == ["id"]


def test_shared_folder_is_the_session_s(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    stored_rows = materialise(spark.range(4), "four")
    assert all(shared_folder(spark) in f for f in stored_rows.inputFiles())
    assert stored_rows.count() == 4


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "yarn", "a"

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)
