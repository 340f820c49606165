import csv
import gzip
import io
import json
import os
import zlib
from datetime import datetime
from glob import glob

import pytest
from pyspark.sql import functions as F

from rillwork import storage
from rillwork.plans import transfers
from rillwork.sinks import blobs, landing, records as out
from rillwork.sources import files, records, tables
from tests.conftest import rows

AWKWARD = [
    ("a", 'say "hi", you'),
    ("b", "two\nlines"),
    ("c", "  spaces  "),
    ("d", None),
    ("e", "back\\slash"),
    ("f", "semi;colon|bar"),
    ("g", "'single'"),
]


def text_of(folder):
    return "".join(open(f, newline="").read() for f in sorted(glob(f"{folder}/part-*")))


def test_csv_text_like_python(spark, folder):
    df = spark.createDataFrame(AWKWARD, "k string, v string").coalesce(1)
    quoted, minimal = io.StringIO(newline=""), io.StringIO(newline="")
    for stream, how in ((quoted, csv.QUOTE_ALL), (minimal, csv.QUOTE_MINIMAL)):
        writer = csv.writer(stream, quoting=how, lineterminator="\n")
        writer.writerow(["k", "v"])
        writer.writerows(AWKWARD)
    out.write_csv(df, f"{folder}/all", quote_all=True)
    out.write_csv(df, f"{folder}/minimal", quote_all=False)
    assert text_of(f"{folder}/all") == quoted.getvalue()
    assert text_of(f"{folder}/minimal") == minimal.getvalue()
    for kind in ("all", "minimal"):
        back = records.read_csv(spark, f"{folder}/{kind}", "k string, v string", multi_line=True)
        assert [tuple(r) for r in back.orderBy("k").collect()] == AWKWARD


def test_json_text_like_python(spark, folder):
    df = spark.createDataFrame([(1, None, datetime(2024, 1, 1, 2, 3, 4, 50), bytearray(b"\x00\xff"))], "i int, n string, t timestamp_ntz, b binary")
    out.write_json_records(df, folder)
    assert json.loads(text_of(folder)) == {"i": 1, "n": None, "t": "2024-01-01T02:03:04.000050", "b": "00ff"}


def test_csv_strings_pad_and_drop(spark, folder):
    os.makedirs(folder)
    with open(f"{folder}/a.csv", "w") as f:
        f.write("x,y,z\n1,2,3\n\n4\n5,6,7,8\n")
    got = records.read_csv_strings(spark, f"{folder}/a.csv").collect()
    assert [tuple(r) for r in got] == [("1", "2", "3"), ("4", None, None), ("5", "6", "7")]
    named = records.read_csv_strings(spark, f"{folder}/a.csv", fieldnames=["p", "q", "r"])
    assert tuple(named.first()) == ("x", "y", "z")


@pytest.mark.parametrize("block", ["128m", "64b"])
def test_skip_rows_per_file(spark, folder, block):
    os.makedirs(folder)
    for name in ("a", "b"):
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write("one\ntwo\ni,s\n" + "".join(f"{i},{name}{i}\n" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = rows(records.read_csv(spark, folder, "i int, s string", skip_rows=2))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((i, f"{n}{i}") for n in "ab" for i in range(200))


def test_skip_rows_refuses_a_head_that_is_too_short(spark, folder):
    os.makedirs(folder)
    with open(f"{folder}/a.csv", "w") as f:
        f.write("".join(f"{i}\n" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        with pytest.raises(Exception, match="fewer than 100 lines"):
            records.without_first_lines(spark, folder, 100).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


DAYS = [("2024-01-01 00:00:00", "2024-01-02 00:00:00"), ("2024-01-02 00:00:00", "2024-01-03 00:00:00")]


def landed(spark, folder):
    table = landing.read_landing(spark, folder)
    return {r._interval_start: r["count"] for r in table.groupBy("_interval_start").count().collect()}


def test_reload_is_idempotent_and_empties(spark, folder):
    df = spark.range(10)
    for start, end in DAYS:
        assert landing.reload_interval(df, folder, start, end) == 10
    assert landing.reload_interval(df.filter("id < 4"), folder, *DAYS[1]) == 4
    assert landing.reload_interval(df.filter("id < 4"), folder, *DAYS[1]) == 4
    assert landed(spark, folder) == {datetime(2024, 1, 1): 10, datetime(2024, 1, 2): 4}
    assert landing.reload_interval(df.filter("id < 0"), folder, *DAYS[1]) == 0
    assert landed(spark, folder) == {datetime(2024, 1, 1): 10}
    assert landing.reload_interval(df, folder, *DAYS[1]) == 10
    assert landed(spark, folder) == {datetime(2024, 1, 1): 10, datetime(2024, 1, 2): 10}


def test_reload_from_empty_start(spark, folder):
    assert landing.reload_interval(spark.range(0), folder, *DAYS[0]) == 0
    assert landed(spark, folder) == {}
    assert landing.reload_interval(spark.range(2), folder, *DAYS[0]) == 2
    assert landed(spark, folder) == {datetime(2024, 1, 1): 2}


def test_interval_filter_prunes_partitions(spark, folder):
    for start, end in DAYS:
        landing.reload_interval(spark.range(3), folder, start, end)
    one = landing.read_landing(spark, folder).filter("_interval_start = TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    assert one.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_interval_start" in plan


def test_staged_load_names_its_file(spark, folder):
    df = spark.range(5).withColumn("d", F.lit("x"))
    loaded = transfers.table_to_warehouse(df, "t", f"{folder}/land", *DAYS[0], stage=f"{folder}/stage")
    assert loaded == 5
    origin = landing.read_landing(spark, f"{folder}/land").select("_loaded_from").distinct().collect()
    names = sorted(r[0] for r in origin)
    assert names == [f"{folder}/stage/t_part{n:03d}.json.gz" for n in range(1, len(names) + 1)]


def test_parts_are_numbered_and_replaced(spark, folder):
    stage = f"{folder}/deep/stage"
    load = lambda df, rows: transfers.table_to_warehouse(df, "t", f"{folder}/land", *DAYS[0], stage=stage, part_rows=rows)
    assert load(spark.range(0, 100, numPartitions=4).filter("id < 50 OR id >= 75"), 10) == 75
    where = landing.read_landing(spark, f"{folder}/land").select(F.expr("src:id::int"), "_loaded_from").collect()
    part = {i: int(name[-11:-8]) for i, name in where}
    assert sorted(set(part.values())) == list(range(1, 10)) and [part[i] for i in sorted(part)] == sorted(part.values())
    assert max(map(list(part.values()).count, part.values())) == 10
    assert load(spark.range(3).repartition(1), 10) == 3 and blobs._names_below(stage) == ["t_part001.json.gz"]
    assert load(spark.range(0), 10) == 0 and blobs._names_below(stage) == []
    assert landing.read_landing(spark, f"{folder}/land").count() == 0
    assert blobs._names_below(f"{folder}/deep") == []


def test_moved_file_stays_moved(folder):
    storage.write_chunks(f"{folder}/a", [b"new"])
    storage.write_chunks(f"{folder}/b", [b"old"])
    for _ in range(2):
        storage.move(f"{folder}/a", f"{folder}/b")
    assert b"".join(storage.read_chunks(f"{folder}/b")) == b"new"
    with pytest.raises(FileNotFoundError):
        storage.move(f"{folder}/a", f"{folder}/c")


def test_long_lists_of_staged_files_are_loaded_in_turns(spark, folder):
    out.write_json_records(spark.range(0, 7, numPartitions=7), f"{folder}/stage")
    landing.copy_into_table(spark, f"{folder}/stage", f"{folder}/t", "load-0", files_per_append=3)
    got = spark.read.schema(landing.STAGED_SCHEMA).parquet(f"{folder}/t")
    assert got.count() == 7 and got.select("etl_filename").distinct().count() == 7
    assert got.select("etl_timestamp").distinct().count() == 1
    landing.copy_into_table(spark, f"{folder}/stage", f"{folder}/t", "load-1", loaded=got, files_per_append=3)
    assert spark.read.schema(landing.STAGED_SCHEMA).parquet(f"{folder}/t").count() == 7


def test_copy_into_may_load_again(spark, folder):
    out.write_json_records(spark.range(3), f"{folder}/stage")
    for n in range(2):
        landing.copy_into_table(spark, f"{folder}/stage", f"{folder}/t", f"load-{n}")
    assert spark.read.schema(landing.STAGED_SCHEMA).parquet(f"{folder}/t").count() == 6


def test_insert_by_position(spark, folder):
    table = landing.create_table(spark, "t_position", "id long, s string", folder)
    landing.insert_by_position(spark.createDataFrame([(1, "a")], "x long, y string"), table)
    assert rows(spark.table(table)) == [(1, "a")]
    assert rows(tables.table_columns(spark, table)) == [(1, "id"), (2, "s")]
    with pytest.raises(ValueError):
        landing.insert_by_position(spark.range(1), table)


@pytest.mark.parametrize("codec", ["gzip", "zlib"])
def test_codecs_like_python(spark, folder, codec):
    content = os.urandom(100) * 1000
    packed = b"".join(storage.deflated([content], codec))
    assert (gzip.decompress if codec == "gzip" else zlib.decompress)(packed) == content
    assert b"".join(storage.inflated([packed[:50], packed[50:]], codec)) == content
    two = gzip.compress(b"a") + gzip.compress(b"b")
    assert b"".join(storage.inflated([two], "gzip")) == b"ab"


def test_blobs(spark, folder):
    df = spark.createDataFrame([("a/x.txt", "one"), ("/b/y.txt", "zwei é")], "p string, d string")
    manifest = blobs.write_blobs(df, folder, "p", "d", metadata=F.lit("m"))
    assert rows(manifest) == [("a/x.txt", 3, "m"), ("b/y.txt", 7, "m")]
    blobs.write_blobs(df, folder, "p", "d", append=True)
    assert open(f"{folder}/a/x.txt").read() == "oneone"
    blobs.write_blobs(df, folder, "p", "d")
    assert open(f"{folder}/a/x.txt").read() == "one"
    read = {r.name: bytes(r.data).decode() for r in files.read_blobs(spark, folder).collect()}
    assert read == {"x.txt": "one", "y.txt": "zwei é"}
    assert not glob(f"{folder}/**/*.part", recursive=True)
    listed = files.list_files(spark, folder, "**/*.txt", exclude_dirs=["b*"], path_format="absolute")
    assert rows(listed, "path", "stem", "suffix", "size") == [(f"{folder}/a/x.txt", "x", ".txt", 3)]


def test_compress_and_back(spark, folder):
    df = spark.createDataFrame([(f"{i}.txt", "text " * i) for i in range(1, 5)], "p string, d string")
    blobs.write_blobs(df, f"{folder}/in", "p", "d")
    transfers.compress_and_copy(spark, f"{folder}/in", f"{folder}/gz", "2024-01-05 00:00:00", "*.txt")
    assert gzip.decompress(open(f"{folder}/gz/2024-01-05/3.txt.gz", "rb").read()) == b"text " * 3
    blobs.decompress_files(spark, f"{folder}/gz", f"{folder}/back", F.regexp_replace("name", r"\.gz$", ""))
    copied = blobs.copy_files(spark, f"{folder}/back", f"{folder}/copy")
    assert copied.count() == 4 and open(f"{folder}/copy/4.txt").read() == "text " * 4


def test_storage_paths():
    assert storage.open_path("file:/a/b")[1] == "/a/b"
    assert storage.open_path("file:///a/b c")[1] == "/a/b c"
    assert storage.open_path("/a/b")[1] == "/a/b"


def test_table_to_files_text(spark, folder):
    df = spark.createDataFrame([(i, f'n"{i}' if i else None) for i in range(5)], "i int, s string")
    manifest = transfers.table_to_files(df, folder, "t", ["i"], batch_size=2)
    assert rows(manifest, "path") == [("t_1.csv",), ("t_2.csv",), ("t_3.csv",)]
    assert open(f"{folder}/t_1.csv").read() == 'i,s\n0,\n1,"n""1"\n'


def test_write_by_template_replaces_only_what_it_gets(spark, folder):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    out.write_by_template(df, folder, ["k"])
    manifest = out.write_by_template(df.filter("k = 1 and id < 4"), folder, ["k"])
    got = spark.read.parquet(folder).groupBy("k").count()
    assert rows(got) == [(0, 5), (1, 2)]
    assert manifest.filter("path LIKE 'k=1/part-%'").count() == 1


def test_jdbc_options():
    plain = tables.jdbc_options("jdbc:x", "t", batch_size=50, user="u")
    assert plain == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "50", "user": "u"}
    split = tables.jdbc_options("jdbc:x", "t", partition_column="d", bounds=(datetime(2024, 1, 1), datetime(2024, 2, 1)), partitions=8)
    assert (split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("2024-01-01 00:00:00", "2024-02-01 00:00:00", "8")
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "t", partition_column="d")


def test_hot_key_is_written_by_several_tasks(spark, folder):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        manifest = out.write_by_template(df.repartition(16), folder, ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    per_key = {r.k: r["count"] for r in manifest.groupBy(F.split("path", "/")[0].alias("k")).count().collect()}
    assert per_key["k=hot"] > 1 and len(per_key) == 6
    assert spark.read.parquet(folder).count() == 60_000


def test_named_texts_below_the_interval(spark, folder):
    items = [("users.txt", "John, Amy, Adam, Jane"), ("fruits.csv", "apple,pear,apricot")]
    texts = spark.createDataFrame(items, "filename string, contents string")
    end = F.translate(F.lit("2021-04-15 01:00:00"), ":", "_")
    place = F.concat(F.lit("/store/"), end, F.lit("/"), "filename")
    manifest = blobs.write_blobs(texts, folder, place, "contents", path_format="absolute")
    assert rows(manifest, "path") == sorted((f"{folder}/store/2021-04-15 01_00_00/{n}",) for n, _ in items)
    assert open(f"{folder}/store/2021-04-15 01_00_00/fruits.csv").read() == "apple,pear,apricot"
    blobs.write_blobs(texts.limit(1), folder, F.lit("20210415/a.txt"), "contents")
    assert open(f"{folder}/20210415/a.txt").read() == "John, Amy, Adam, Jane"


def test_globs_and_listings(spark, folder):
    names = ["x.txt", "y.csv", "sub/y.txt", "sub/deep/z.txt", "k=1/w.txt"]
    df = spark.createDataFrame([(n, "1") for n in names], "p string, d string")
    blobs.write_blobs(df, folder, "p", "d")

    def found(pattern):
        return [r[0] for r in rows(files.list_files(spark, folder, pattern), "path")]

    assert found("**/*") == sorted(names)
    assert found("*.txt") == found("/*.txt") == ["x.txt"]
    assert found("**/*.txt") == sorted(n for n in names if n.endswith("txt"))
    assert found("sub/*.txt") == ["sub/y.txt"]
    assert found("s*/**/?.txt") == ["sub/deep/z.txt", "sub/y.txt"]
    assert found("**/deep/*") == ["sub/deep/z.txt"]
    assert rows(files.list_directory(spark, folder)) == [("k=1",), ("sub",), ("x.txt",), ("y.csv",)]
    assert rows(files.list_directory(spark, f"{folder}/sub", "url")) == [(f"file:{folder}/sub/deep",), (f"file:{folder}/sub/y.txt",)]
    assert rows(files.read_blobs(spark, folder, "sub/*"), "name") == [("y.txt",)]

    odd = ["a b+c é%41.txt", "a b/x.txt"]
    blobs.write_blobs(spark.createDataFrame([(n, "1") for n in odd], "p string, d string"), f"{folder}2", "p", "d")
    assert rows(files.list_files(spark, f"{folder}2"), "path") == sorted((n,) for n in odd)
    assert rows(files.list_files(spark, f"{folder}2", "a b+*.txt"), "path") == [(odd[0],)]
    one = files.read_blobs(spark, folder, "sub/*")
    scans = one._jdf.queryExecution().executedPlan().collectLeaves()
    one.collect()
    assert scans.apply(0).metrics().apply("numFiles").value() == 1


def test_rates_as_csv_with_bars(spark, folder):
    from rillwork.operators.flow import flatten_rates

    rates = spark.sql("SELECT map('2021-03-12', named_struct('EUR', 0.5D, 'PHP', 48.25D)) rates, 'USD' base")
    out.write_csv(flatten_rates(rates), folder, delimiter="|")
    assert text_of(folder) == '"EUR"|"PHP"|"base"|"date"\n"0.5"|"48.25"|"USD"|"2021-03-12"\n'


def test_loaded_files_are_left_out(spark, folder):
    out.write_json_records(spark.range(3), f"{folder}/stage")
    landing.copy_into_table(spark, f"{folder}/stage", f"{folder}/t", "load-0")
    out.write_json_records(spark.range(5), f"{folder}/stage", mode="append")
    so_far = spark.read.schema(landing.STAGED_SCHEMA).parquet(f"{folder}/t")
    landing.copy_into_table(spark, f"{folder}/stage", f"{folder}/t", "load-1", loaded=so_far)
    got = spark.read.schema(landing.STAGED_SCHEMA).parquet(f"{folder}/t").groupBy("etl_id").count()
    assert rows(got) == [("load-0", 3), ("load-1", 5)]


def test_interval_of_a_table_by_day(spark, folder):
    df = spark.range(240).select("id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours="id")).alias("ts"))
    out.write_by_template(df.withColumn("day", F.to_date("ts")), folder, ["day"])
    table = spark.read.parquet(folder)
    got = tables.read_interval(table, "ts", "2024-01-03 12:00:00", "2024-01-04 00:00:00", day_column="day")
    assert rows(got, "id") == [(i,) for i in range(60, 72)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    edge = tables.read_interval(table, "ts", "2024-01-03 00:00:00", "2024-01-04 00:00:00", day_column="day")
    assert edge.count() == 24


def test_equal_file_names_in_two_folders_are_two_files(spark, folder):
    for day, value in (("day1", 1), ("day2", 2)):
        rows_ = spark.createDataFrame([('{"a": %d}' % value, 0)], "value string, _id long").withColumn("name", F.lit(f"{day}/t_part001.json.gz"))
        blobs.write_gzip_lines(rows_.select("name", "_id", "value"), f"{folder}/stage/{day}-tmp")
    stage = f"{folder}/both"
    for day in ("day1", "day2"):
        blobs.copy_files(spark, f"{folder}/stage/{day}-tmp", stage)
        so_far = spark.read.schema(landing.STAGED_SCHEMA).parquet(f"{folder}/t") if day == "day2" else None
        landing.copy_into_table(spark, stage, f"{folder}/t", day, loaded=so_far)
    got = spark.read.schema(landing.STAGED_SCHEMA).parquet(f"{folder}/t")
    assert rows(got, "etl_id", "etl_filename") == [("day1", "day1/t_part001.json.gz"), ("day2", "day2/t_part001.json.gz")]


def test_two_intervals_with_one_start(spark, folder):
    df = spark.range(5)
    landing.reload_interval(df, folder, "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    for n in (2, 3):
        landing.reload_interval(df.limit(n), folder, "2024-01-01 00:00:00", "2024-01-01 01:00:00")
    counts = landing.read_landing(spark, folder).groupBy("_interval_end").count()
    assert sorted(r["count"] for r in counts.collect()) == [3, 5]
    landing.reload_interval(df.limit(0), folder, "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert landing.read_landing(spark, folder).count() == 3


def test_equal_names_are_compressed_to_two_files(spark, folder):
    for place in ("a", "b"):
        blobs.write_blobs(spark.range(1).select(F.lit(f"{place}/x.txt").alias("p"), F.lit(place).alias("d")), f"{folder}/in", "p", "d")
    made = transfers.compress_and_copy(spark, f"{folder}/in", f"{folder}/out", "2024-01-01 00:00:00")
    assert made.count() == 2 == files.list_files(spark, f"{folder}/out").count()
    with pytest.raises(ValueError):
        transfers.compress_and_copy(spark, f"{folder}/in", f"{folder}/out", "2024-01-01 00:00:00", target=F.col("name"))


@pytest.mark.parametrize("quote_all", [True, False])
def test_null_in_the_only_column_keeps_its_row(spark, folder, quote_all):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    out.write_csv(df, f"{folder}/csv", quote_all=quote_all)
    assert records.read_csv(spark, f"{folder}/csv", df.schema).count() == 3
    transfers.table_to_files(df, f"{folder}/files", "t", ["x"])
    assert records.read_csv(spark, f"{folder}/files", df.schema).count() == 3
    out.write_csv(df.limit(0), f"{folder}/none", quote_all=quote_all)
    assert spark.read.text(f"{folder}/none").count() == 0


def test_skipped_lines_and_quoted_breaks(spark, folder):
    text = 'junk\nmore junk\na,b\n1,"two\nlines"\n2,plain\n'
    blobs.write_blobs(spark.range(1).select(F.lit("f.csv").alias("p"), F.lit(text).alias("d")), folder, "p", "d")
    got = records.read_csv(spark, f"{folder}/f.csv", "a int, b string", multi_line=True, skip_rows=2)
    assert rows(got) == [(1, "two\nlines"), (2, "plain")]


def test_glob_classes(spark, folder):
    names = spark.createDataFrame([(f"d/{c}.txt",) for c in "wxyz[^"], "p string")
    blobs.write_blobs(names, folder, "p", "p")
    found = lambda glob: {r.name for r in files.list_files(spark, folder, glob).collect()}
    assert found("**/[x-z].txt") == {"x.txt", "y.txt", "z.txt"}
    assert found("d/[!x-z].txt") == {"w.txt", "[.txt", "^.txt"}
    assert found("d/[w^].txt") == {"w.txt", "^.txt"}
    assert found("d/[.txt") == {"[.txt"}


def test_free_paths_and_their_manifest(spark, folder):
    df = spark.range(6).withColumn("kind", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    place = F.concat("kind", F.lit("/of/"), (F.col("id") % 3).cast("string"), F.lit(".json"))
    got = out.write_to_paths(df, folder, place, ["id"])
    assert rows(got, "path", "n_rows") == sorted((f"{k}/of/{i}.json", 1) for k in ("even", "odd") for i in range(3))
    assert files.list_files(spark, folder).count() == 6
    csv_files = out.write_to_paths(df, f"{folder}-csv", F.lit("all.csv"), ["id"], "csv", ["id", "kind"])
    assert rows(csv_files, "path", "n_rows") == [("all.csv", 6)]
    assert records.read_csv(spark, f"{folder}-csv/all.csv", "id long, kind string").count() == 6


def test_manifest_of_an_append_has_its_own_files_only(spark, folder):
    df = spark.range(4).withColumn("k", F.col("id") % 2).coalesce(1)
    first = out.write_by_template(df, folder, ["k"])
    assert first.count() == 2
    more = out.write_by_template(df.filter("k = 0"), folder, ["k"], append=True)
    assert more.count() == 1 and files.list_files(spark, folder, "**/part-*").count() == 3


def test_several_intervals_in_one_pass(spark, folder):
    df = spark.range(48).select("id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours="id")).alias("ts"))
    spans = [("2024-01-01 00:00:00", "2024-01-02 00:00:00"), ("2024-01-01 12:00:00", "2024-01-02 12:00:00"), ("2024-01-03 00:00:00", "2024-01-04 00:00:00")]
    for _ in range(2):
        assert landing.reload_intervals(df, folder, "ts", spans) == [24, 24, 0]
    assert landing.read_landing(spark, folder).count() == 48
    assert landing.reload_intervals(df.filter("id >= 24"), folder, "ts", spans) == [0, 12, 0]
    assert landing.read_landing(spark, folder).count() == 12


def test_whole_files_go_to_python_in_small_batches(spark, folder, monkeypatch):
    key, seen, settle = "spark.sql.execution.arrow.maxBytesPerBatch", [], blobs.settle

    def noted(df, label):
        seen.append(spark.conf.get(key))
        return settle(df, label)

    monkeypatch.setattr(blobs, "settle", noted)
    known = spark.conf.get(key)
    data = F.when(F.col("id") != 3, F.repeat(F.col("id").cast("string"), 1 << 20))
    made = blobs.write_blobs(spark.range(0, 12, 1, 1).withColumn("data", data), folder, F.format_string("a/%d.txt", "id"), "data")
    assert rows(made, "path", "size") == sorted((f"a/{i}.txt", 0 if i == 3 else len(str(i)) << 20) for i in range(12))
    assert seen == [str(blobs.BATCH)] and spark.conf.get(key) == known
    read = spark.read.format("binaryFile").load(f"{folder}/a").selectExpr("element_at(split(path, '/'), -1) AS name", "CAST(content AS STRING) AS text")
    assert read.filter("text <> repeat(split(name, '[.]')[0], 1048576) AND name <> '3.txt'").count() == 0
