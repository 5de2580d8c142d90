"""Mixing, sharding and the pipeline, and how the queries are registered."""

import hashlib
import pathlib
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from brute import contamination, near_duplicates, smallest_capacity, spaced_words, targets
from marketloom.llm import mixing, shards
from marketloom.session import cut_lineage

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def sized(spark, groups):
    """Documents of given word counts by source, with columns whose names clash."""
    rows, draw = [], random.Random(1)
    for source, sizes in groups.items():
        rows += [(len(rows) + i, " ".join("w" * draw.randrange(1, 5) for _ in range(n)), source, 1, "k") for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, key string")


GROUPS = {"a": [5, 9, 100], "b": [3] * 40, "c": [1000], "d": [0, 0], None: [50, 60], "é": [10] * 30, "": [7], "B": [1]}


@pytest.mark.parametrize("bucket_rows", [50_000, 3])
def test_mix(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (3, 0, 0), (None, 1, 0), (7, None, 0)], LABELS)
    rows = mixing.mix(sized(spark, GROUPS), labels).collect()
    assert len(rows) == sum(map(len, GROUPS.values()))
    names = sorted((s for s in GROUPS if s is not None)) + [None]
    want = dict(zip(names, targets([sum(GROUPS[s]) for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(want[r["source"]])
        epochs = int(r["target"] // r["source_size"]) if r["source_size"] else 0
        assert epochs * r["size"] <= r["taken"] <= (epochs + 1) * r["size"]
    for source, own in by.items():
        assert sum(r["size"] for r in own) == own[0]["source_size"] == sum(GROUPS[source])
        assert abs(sum(r["taken"] for r in own) - want[source]) <= 0.5
        part = [r for r in own if r["source_size"] and 0 < r["taken"] % r["size"] if r["size"]]
        assert len(part) <= 1


def test_mix_does_not_depend_on_buckets(spark, monkeypatch):
    docs, labels = sized(spark, GROUPS), spark.createDataFrame([(1, 1, 0)], LABELS)
    wide = sorted(map(tuple, mixing.mix(docs, labels).collect()), key=str)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert wide == sorted(map(tuple, mixing.mix(docs.repartition(7), labels).collect()), key=str)


def test_good_documents_are_taken_more_often(spark):
    docs = sized(spark, {"a": [10] * 400, "b": [10] * 400})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(800)], LABELS)
    taken = Counter()
    for r in mixing.mix(docs, labels).where("source = 'b'").collect():
        taken[r["doc_id"] % 2] += r["taken"]
    assert taken[1] > 1.5 * taken[0]


def test_mix_of_odd_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([(1, None, "a"), (1, "x y", "a"), (1, "x y", "a"), (None, "z", None)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == 4 and sum(r["taken"] for r in rows) == 5
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(docs.where("text is null"), labels).collect())


def test_mixed_rows_are_whole_documents(spark):
    docs, labels = sized(spark, GROUPS), spark.createDataFrame([(1, 1, 0)], LABELS)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, labels).collect()}
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})


def capacity(rows):
    """Size of the largest shard, by brute force over groups in order of their digest."""
    groups = Counter()
    for text in rows:
        body = (text or "").encode()
        groups[hashlib.sha256(body).hexdigest()] += len(body) + 1
    return smallest_capacity([groups[k] for k in sorted(groups)], shards.SHARDS)


@pytest.mark.parametrize("case", ["even", "few", "hot", "skewed", "one"])
def test_shards_have_the_smallest_capacity(spark, monkeypatch, case):
    monkeypatch.setattr(shards, "FIRST_BITS", 3)
    monkeypatch.setattr(shards, "SPLIT_BITS", 2)
    draw = random.Random(case)
    texts = {"even": ["x" * draw.randrange(5, 30) + str(i) for i in range(300)], "few": [str(i) * 9 for i in range(9)],
             "hot": ["same"] * 200 + [f"é{i}" for i in range(200)] + [None, "", ""], "one": ["only"],
             "skewed": [str(i) + "z" * int(1.5 ** draw.randrange(14)) for i in range(150)]}[case]
    docs = spark.createDataFrame([(i, t, 3, "k") for i, t in enumerate(texts)], "doc_id long, text string, shard int, key string")
    rows = {r["doc_id"]: r for r in shards.shard(docs).collect()}
    total, place, slots = Counter(), {}, defaultdict(list)
    for i, text in enumerate(texts):
        r, body = rows[i], (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        assert 0 <= r["shard"] < 16 and place.setdefault(body, r["shard"]) == r["shard"]
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(total.values()) == capacity(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")
    assert shards.shard(docs).count() == 3 and shards.shard(docs.limit(0)).count() == 0


def test_pipeline_equals_brute_force(spark):
    """Every stage on what its predecessor kept."""
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = None
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "mixing_sources", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in entry.queries()["op7_toxicity"](spark, SF).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = cut_lineage(stage(spark, docs, SF), name)
        rows = [r.asDict() for r in docs.collect()]
        if name != "sharding":
            assert docs.columns == columns
        ids = sorted(r["doc_id"] for r in rows)
        if name == "toxicity":
            assert ids == sorted(i for i, p in scored.items() if not p)
        elif name == "minhash_near_dedup":
            before.sort(key=lambda r: r["doc_id"])
            _, component = near_duplicates([r["text"] for r in before])
            assert ids == [r["doc_id"] for i, r in enumerate(before) if component[i] == i]
        elif name == "benchmark_decontamination":
            assert ids == sorted(r["doc_id"] for r in before if not contamination(r["text"], items)[-1])
        elif name == "mixing_sources":
            size, taken = Counter(), Counter()
            for r in before:
                size[r["source"]] += len(spaced_words(r["text"]))
            for r in rows:
                taken[r["source"]] += len(spaced_words(r["text"]))
            names = sorted(size)
            want = targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
            longest = max(len(spaced_words(r["text"])) for r in before)
            assert all(abs(taken[s] - w) <= longest / 2 + 1 for s, w in zip(names, want))
        else:
            assert Counter(ids) == Counter(r["doc_id"] for r in before)
            total = Counter()
            for r in rows:
                total[r["shard"]] += r["size"]
            assert max(total.values()) == capacity([r["text"] for r in before])
        kept = rows
    assert kept


def test_stages_keep_columns_with_clashing_names(spark):
    names = ["row", "score", "features", "id", "doc", "print", "copies", "label", "_doc", "_copy", "size", "raw", "calibrated", "predicted", "held_out"]
    rows = [(i, f"some words of text number {i} and {i * 7} more", "a", *["x"] * len(names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r["doc_id"] for r in out.collect()} == set(range(6)), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 6


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_ten_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None


def test_entry_works_without_the_subpackage(tmp_path):
    root = pathlib.Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "marketloom"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    for p in (root / "marketloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "marketloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op1') or n == 'pipeline']; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]
