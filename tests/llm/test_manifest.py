"""The Merkle manifest against a plain tree, and its proofs against forged rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import common, merkle_manifest
from tests.llm.test_documents import duck, same


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, run=2):
    """The top, and for each leaf the (before, after) of its levels."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, at):
            first = k - k % run
            p.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + run])))
        nodes = [h(*nodes[k : k + run]) for k in range(0, len(nodes), run)]
        at = [k // run for k in at]
    return nodes[0], paths


def plain_manifest(rows, run=2):
    """(row, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], run) for g in order]
    root, upper = plain_tree([t[0] for t in trees], run) if trees else (None, [])
    return [(x[3], x[2], t[0], root, p + up) for g, t, up in zip(order, trees, upper) for x, p in zip(sorted(groups[g], key=lambda x: x[:3]), t[1])]


def plain_digest(rows):
    out = []
    for r, leaf, subroot, root, path in plain_manifest(rows):
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        node = plain_leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf
        for before, after in path:
            node = h(before, node, after)
        out.append((r[0], leaf, subroot, root, h(*(x for s in path for x in s)), node, node == root))
    return out


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"
ROWS = [(k, "s", "en", 3, f"text {k}") for k in range(70)] + [(k, None, "de", None, "ä\nö") for k in range(70, 73)] + [(80, "s", None, 5, None), (81, "s", None, 5, ""), (None, "s", "en", 1, "x"), (None, "s", "en", 1, "x"), (90, "t", "zz", 9, "lone"), (95, "", "", 2**63 - 1, "none"), (5, "s", "en", 3, "another of this id"), (7, "s", "en", 3, "text 7"), (7, "s", "en", 3, "text 7"), (99, "s", "é", 4, "long " * 50_000)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, COLUMNS).selectExpr("*", "1 as key", "2 as node", "3 as at", "4 as path", "5 as id", "6 as block", "7 as item")


def test_digest_is_that_of_a_plain_tree_and_of_sql(rows):
    got = merkle_manifest.digest(rows)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_digest(ROWS))
    assert same(got, *duck(merkle_manifest.ORACLE_SQL, ROWS, columns="doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar"))
    assert {r.verified for r in got.collect()} == {True, False}


@pytest.mark.parametrize("run, depth", [(2, 3), (3, 2)])
def test_blocks_of_any_size_make_the_same_tree(spark, rows, run, depth):
    got = merkle_manifest.manifest(rows.repartition(5), run=run, depth=depth).collect()
    want = Counter((r[0], leaf, subroot, root, tuple(path)) for r, leaf, subroot, root, path in plain_manifest(ROWS, run))
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in got) == want


def test_proofs_fold_to_the_root_and_forged_leaves_do_not(rows):
    found = merkle_manifest.manifest(rows)
    good = merkle_manifest.fold(F.col("leaf"), F.col("path")) == F.col("root")
    forged = merkle_manifest.fold(F.sha2(F.col("leaf"), 256), F.col("path")) == F.col("root")
    assert set(map(tuple, found.select(good, forged).distinct().collect())) == {(True, False)}


def test_root_tells_tables_apart(spark, rows):
    root = merkle_manifest.root_of(rows)
    assert root == plain_manifest(ROWS)[0][3] == merkle_manifest.root_of(rows.repartition(3))
    assert merkle_manifest.root_of(rows.where("doc_id <> 3 or doc_id is null")) != root
    lone = spark.createDataFrame(ROWS[:1], COLUMNS)
    assert merkle_manifest.root_of(lone) == plain_leaf(ROWS[0])
    assert [tuple(r) for r in merkle_manifest.digest(lone).collect()] == plain_digest(ROWS[:1])
    assert merkle_manifest.root_of(lone.where("false")) is None and merkle_manifest.digest(lone.where("false")).count() == 0


def test_repeated_rows_are_spread(spark):
    df = spark.range(4000).repartition(8).selectExpr("'k' as key", "1L as id", "'same' as node")
    got = merkle_manifest.placed(df, "id", "node")
    assert sorted(r["at"] for r in got.select("at").collect()) == list(range(4000))
    held = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles() if "/sorted/" in f})
    sizes = [r["n"] for r in held.groupBy(F.shiftrightunsigned("row", 33)).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_changed_added_and_missing_rows_are_found(spark, rows):
    proofs = merkle_manifest.manifest(rows).select("doc_id", "leaf", "path")
    root = plain_manifest(ROWS)[0][3]
    assert merkle_manifest.failing(rows, proofs, root).count() == 0
    edited = [(*r[:4], "x") if r[0] == 12 else r for r in ROWS if r[0] not in (20, 71)] + [(700, "s", "en", 3, "new"), (7, "s", "en", 3, "not the text of 7")]
    got = merkle_manifest.failing(spark.createDataFrame(edited, COLUMNS), proofs, root).collect()
    assert sorted(map(tuple, got)) == [(7, "changed"), (12, "changed"), (20, "missing"), (71, "missing"), (700, "added")]
    # a part of the table is held against its own proofs
    some = "doc_id between 30 and 50"
    assert merkle_manifest.failing(rows.where(some), proofs.where(some), root).count() == 0


def test_other_columns_and_identities(spark):
    df = spark.createDataFrame([("a", 1, 1.5), ("b", 1, None), ("c", 2, 2.5)], "name string, part int, x double")
    got = merkle_manifest.manifest(df, "name", "part", ("name", "x")).collect()
    leaves = {r.name: r.leaf for r in got}
    assert leaves == {"a": h("1:a", "3:1.5"), "b": h("1:b", "-"), "c": h("1:c", "3:2.5")}
    assert {r.root for r in got} == {h(h(leaves["a"], leaves["b"]), leaves["c"])}


def test_tables_are_broadcast_by_their_bytes(spark, monkeypatch):
    flat = spark.range(1000).selectExpr("id", "id + 1 as other")
    lists = spark.range(1000).selectExpr("id", "transform(sequence(1, 500), x -> struct(x as b1, x as b2)) as meets")
    is_broadcast = lambda df: "Hint" in df._jdf.queryExecution().logical().toString()
    assert is_broadcast(common.sized(flat)) and is_broadcast(common.sized(lists))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1 << 20)
    assert is_broadcast(common.sized(flat)) and not is_broadcast(common.sized(lists))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 999)
    assert not is_broadcast(common.sized(flat))
    assert common.sized(flat.where("false")).count() == 0


def test_settled_queries_leave_one_table(spark, tmp_path):
    seen = []

    @common.settled
    def some_query(spark, folder):
        common.bounded_batches(spark)
        held = common.written(spark.range(9), "held")
        seen.append(held.inputFiles()[0])
        return held.where("id > 3")

    before = spark.conf.get(common.BATCH)
    out = some_query(spark, "")
    assert out.count() == 5 and spark.conf.get(common.BATCH) == before
    with pytest.raises(Exception):
        spark.read.parquet(seen[0]).count()


def test_chained_steps_leave_the_last_table(spark):
    folders, tables = [], []

    def step(add):
        def run(df):
            folders.extend(f.rsplit("/", 1)[0] for f in common.written(df, "aside").inputFiles())
            tables.append(df)
            return df.select((df["id"] + add).alias("id"))

        return run

    out = common.chained(spark.range(5), [("one", step(1)), ("two", step(10)), ("three", step(100))])
    assert sorted(r.id for r in out.collect()) == [111, 112, 113, 114, 115]
    there = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    assert not any(there(f) for f in folders) and there(out.inputFiles()[0])
    for df in tables[1:]:
        with pytest.raises(Exception):
            df.collect()
