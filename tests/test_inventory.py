import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeclerk.operators import compare_snapshots, file_inventory, path_pattern, resource_sets
from lakeclerk.sources.listing import files_below, listing_tasks, name_pattern
from lakeclerk import Catalog
from lakeclerk.streaming import scan


def put(folder, name, text):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def names(df, column="path"):
    return sorted(Path(row[column]).name for row in df.collect())


def test_inventory_lists_files_without_content(spark, folder):
    put(folder, "a/x.txt", "12345")
    put(folder, "a/b/y.txt", "1")
    put(folder, "a/_SUCCESS", "")
    rows = {Path(row.path).name: row.n_bytes for row in file_inventory(spark, folder).collect()}
    assert rows == {"x.txt": 5, "y.txt": 1}
    plan = file_inventory(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_added_changed_removed(spark, folder):
    put(folder, "d/keep", "k")
    changed = put(folder, "d/size", "1")
    touched = put(folder, "d/touch", "1")
    removed = put(folder, "d/gone", "1")
    before = scan(spark, f"{folder}/d", f"{folder}/inv", "Full")
    assert before.count() == 4
    changed.write_text("12")
    later = time.time() + 60
    os.utime(touched, (later, later))
    removed.unlink()
    put(folder, "d/new", "n")
    changes = scan(spark, f"{folder}/d", f"{folder}/inv")
    assert {(Path(row.path).name, row.change) for row in changes.collect()} == {
        ("size", "changed"),
        ("touch", "changed"),
        ("gone", "removed"),
        ("new", "added"),
    }
    assert scan(spark, f"{folder}/d", f"{folder}/inv").isEmpty()


def test_first_incremental_scan_reports_everything_as_added(spark, folder):
    put(folder, "d/a", "1")
    rows = scan(spark, f"{folder}/d", f"{folder}/inv").collect()
    assert [(Path(row.path).name, row.change) for row in rows] == [("a", "added")]


def test_level_is_checked(spark, folder):
    with pytest.raises(ValueError):
        scan(spark, folder, folder, "Partial")


def test_equal_snapshots_do_not_differ(spark, folder):
    put(folder, "a", "1")
    files = file_inventory(spark, folder)
    assert compare_snapshots(files, files).isEmpty()


def test_scans_of_other_names_do_not_disturb(spark, folder):
    put(folder, "a/x", "1")
    put(folder, "b/y", "1")
    base = f"{folder}/inv"
    scan(spark, f"{folder}/a", base, "Full", name="a")
    first = scan(spark, f"{folder}/b", base, name="b").collect()
    assert [(Path(row.path).name, row.change) for row in first] == [("y", "added")]
    put(folder, "a/z", "1")
    later = scan(spark, f"{folder}/a", base, name="a").collect()
    assert [(Path(row.path).name, row.change) for row in later] == [("z", "added")]


def test_a_scan_stays_with_its_paths_and_glob(spark, folder):
    put(folder, "a/x.txt", "1")
    base = f"{folder}/inv"
    scan(spark, f"{folder}/a", base)
    with pytest.raises(ValueError, match="is of"):
        scan(spark, folder, base)
    with pytest.raises(ValueError, match="is of"):
        scan(spark, f"{folder}/a", base, glob="*.txt")


def test_scanned_sets_are_found_in_the_catalogue(spark, folder):
    put(folder, "lake/t/k=1/x.parquet", "12")
    put(folder, "lake/t/k=2/y.parquet", "1")
    catalog = Catalog(spark, f"{folder}/catalog")
    files = catalog.scan(f"{folder}/lake", "Full")
    assert files.count() == 2
    names = spark.createDataFrame([(f"file:{folder}/lake/t",)], "qualified_name string")
    assert catalog.resolve(names).first().name == "t"
    found = catalog.read("entities").first()
    assert found.attributes == {"n_files": "2", "n_bytes": "3"}


def test_resource_sets_strip_partition_folders(spark, folder):
    for part in ("k=1/m=a/x", "k=1/m=b/x", "k=1/m=b/y", "k=2/m=a/x"):
        put(folder, f"t/{part}", "12")
    put(folder, "plain/x", "1")
    put(folder, "odd/k=1/inner/x", "1")
    rows = {
        row.resource_set.split(Path(folder).name + "/")[1]: (row.n_directories, row.n_files, row.n_bytes)
        for row in resource_sets(file_inventory(spark, folder)).collect()
    }
    assert rows == {"t": (3, 4, 8), "plain": (1, 1, 1), "odd/k=1/inner": (1, 1, 1)}


def test_paths_are_generalised(spark):
    cases = {
        "a/2024-01-31/f.csv": "a/{date}/f.csv",
        "a/20240131_7.csv": "a/{date}_{n}.csv",
        "a/2024-13-31/x": "a/{n}-{n}-{n}/x",
        "t/k=v 1/m=/part-0001.parquet": "t/k={value}/m={value}/part-{n}.parquet",
        "t/x=1": "t/x={n}",
        "u/part-3-3f2504e0-4f89-11d3-9a0c-0305e82c3301-c000.parquet": "u/part-{n}-{uuid}-c{n}.parquet",
        "h/0123456789abcdef0123/deadbeef": "h/{id}/deadbeef",
        "h/part-7-91e9fb9f20120131afb9e8aec4d2a1b0.json": "h/part-{n}-{id}.json",
        "plain/name": "plain/name",
    }
    df = spark.createDataFrame([(path,) for path in cases], "path string")
    assert {r.path: r.p for r in df.select("path", path_pattern(F.col("path")).alias("p")).collect()} == cases


def test_listing_is_dealt_over_tasks_and_passes_hidden_files(spark, folder):
    for n in range(40):
        put(folder, f"t/a={n % 5}/b={n}/f{n}.csv", "x" * n)
    for name in ("t/_SUCCESS", "t/a=1/.hidden", "t/_temporary/0/f.csv", "t/top.txt"):
        put(folder, name, "y")
    work = listing_tasks([f"{folder}/t"], tasks=8)
    assert len(work) == 8
    found = [f[0] for some in work for item in some for f in files_below(*item, "*.{csv,txt}")]
    assert len(found) == len(set(found)) == 41
    files = file_inventory(spark, f"{folder}/t", "*.csv", tasks=8)
    assert files.count() == 40 and files.rdd.getNumPartitions() == 8
    assert sum(r.n_bytes for r in files.collect()) == sum(range(40))
    assert file_inventory(spark, f"{folder}/absent").isEmpty()
    assert name_pattern(None) is None and name_pattern("a?[0-9].c*").match("ab7.csv")
