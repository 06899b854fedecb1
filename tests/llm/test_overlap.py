import importlib
import random
import re

import pyarrow as pa
import pytest

from cliploom.llm import overlap, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, size=5):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, least=0.8):
    """Smallest id of each document's component, all pairs compared."""
    ids = sorted(i for i, _ in docs)
    sets, root = {i: grams(t) for i, t in docs}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if not union or common / union >= least:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(1, None), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one two three")]
    for base in range(25):
        words = rng.choices(vocabulary, k=rng.choice([5, 9, 24, 60, 200]))
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs) + 7, " ".join(copy + rng.choices(vocabulary, k=rng.choice([0, 0, 1, 6])))))
    shared = " ".join(rng.choices(vocabulary, k=40))
    docs += [(len(docs) + 7 + i, f"{shared} {' '.join(rng.choices(vocabulary, k=30))}") for i in range(30)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "drawn"), [(1, 8), (2, 1), (3, 0)])
def test_same_as_all_pairs(spark, monkeypatch, seed, drawn):
    monkeypatch.setattr(overlap, "DRAWN", drawn)
    docs = corpus(seed)
    want = brute(docs)
    found = {r["doc_id"]: r["component_id"] for r in overlap.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == want and len(set(want.values())) < len(docs) - 20


def test_bound_itself_counts(spark):
    words = [f"v{i}" for i in range(13)]  # nine shingles
    docs = [(1, " ".join(words)), (2, " ".join([*words[:12], "x"])), (3, " ".join([*words, "y", "z"])), (4, " ".join([*words, "a", "b", "c"]))]
    found = {r["doc_id"]: r["component_id"] for r in overlap.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4} == brute(docs)  # 8 of 10, 9 of 11, 9 of 12


def test_rows_without_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "lonely"), (7, "a b"), (7, "a b")], "doc_id int, text string")
    rows = sorted((tuple(r) for r in overlap.near_copies(docs).collect()), key=repr)
    assert rows == [(7, 7), (7, 7), (None, 7), (None, None)]
    assert overlap.near_copies(docs.limit(0)).count() == 0


def test_grid_of_fingerprints_gives_links(spark, monkeypatch):
    """Without the set join's candidates, near copies whose fingerprints are close are linked, and only similar texts are."""
    none = "a long, b long"
    monkeypatch.setattr(overlap, "_drawn_pairs", lambda cells, least: cells.sparkSession.createDataFrame([], none))
    monkeypatch.setattr(overlap, "_cell_links", lambda named, sets, least: sets.sparkSession.createDataFrame([], none))
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    docs = [(4, " ".join(words)), (9, " ".join([*words, "tail"])), (11, " ".join(f"u{rng.randrange(5000)}" for _ in range(600)))]
    docs += [(20, "a b a b a b"), (21, "b a b a b a b a")]  # sets of the same two shingles
    prints = [simhash.fingerprint(text.encode(), 5) for _, text in docs[:2]]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS
    found = {r["doc_id"]: r["component_id"] for r in overlap.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[4] == found[9] == 4 and found[11] == 11


def test_pipeline_stage_drops_near_copies_of_distant_fingerprints(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (2465, 5733, 596, 917)")
    kept = {r["doc_id"] for r in dict(pipeline.STAGES)["near-duplicate removal"](spark, table, "").collect()}
    assert kept == {2465, 596}


@pytest.mark.parametrize("most", [2, 3, 100])
def test_shared_shingles_over_batch_borders(monkeypatch, most):
    monkeypatch.setattr(overlap, "MOST", most)
    rng = random.Random(most)
    rows = sorted((2 * rng.choice([1, 2, 3, 4, rng.randrange(5, 90)]), rng.randrange(9)) for _ in range(150))
    batches, at = [], 0
    while at < len(rows):
        part = rows[at : (at := at + rng.randint(1, 12))]
        batches.append(pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64()),
                                                   pa.array([1] * len(part), pa.int32())], names=["s", "key", "n"]))
    holders = {x: {y for z, y in rows if z == x} for x, _ in rows}
    want = [(x, y, 1, min(most, len(holders[x]))) for x, y in sorted(set(rows)) if len(holders[x]) > 1]
    assert [tuple(r.values()) for b in overlap._shared(iter(batches)) for r in b.to_pylist()] == want


def test_common_shingles_count_as_held_by_many():
    """Odd numbers are common: a task may hold only one of their rows."""
    batch = pa.RecordBatch.from_arrays([pa.array([3, 4, 5, 5], pa.int64()), pa.array([1, 1, 1, 2], pa.int64()), pa.array([1] * 4, pa.int32())],
                                       names=["s", "key", "n"])
    got = [tuple(r.values()) for b in overlap._shared(iter([batch])) for r in b.to_pylist()]
    assert got == [(3, 1, 1, overlap.MOST), (5, 1, 1, overlap.MOST), (5, 2, 1, overlap.MOST)]


def test_common_line_and_hot_copies(spark, monkeypatch):
    """A line that all texts hold and a text that a third of the rows repeat change no component."""
    monkeypatch.setattr(overlap, "SEEN", 3)
    rng = random.Random(4)
    line = "this line stands at the top of every text that was ever written here"
    docs = [(i, f"{line} " + " ".join(f"t{rng.randrange(400)}" for _ in range(rng.choice([2, 12, 40])))) for i in range(60)]
    docs += [(100 + i, f"{line} and the same words follow it in all of these") for i in range(40)]
    docs += [(200 + i, docs[i][1] + " tail") for i in range(0, 60, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    common = overlap.common_shingles(df, "text", 5)
    assert len(common) >= 9 and (common & 1 == 0).all()
    assert {r["doc_id"]: r["component_id"] for r in overlap.near_copies(df).collect()} == brute(docs)


@pytest.mark.parametrize("block", [1, 3, 50])
def test_links_of_a_crowded_cell(spark, monkeypatch, block):
    """The links that come out join exactly what all links between unconnected texts join, and are few."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "COLUMNS", 7)
    rng = random.Random(block)
    sets = {key: rng.sample(range(2, 40, 2), 16) if key % 4 else [*range(2, 34, 2)] for key in range(50)}
    rows = [(s, key % parts, key, 16) for s, parts, m in ((2, 3, 23), (4, 1, 9), (6, 30, 50)) for key in range(m)]
    named = spark.createDataFrame(rows, "s long, part long, key long, n int")
    table = spark.createDataFrame(list(sets.items()), "key long, shared array<long>")
    got = [tuple(r) for r in overlap._cell_links(named, table, 0.6).collect()]
    similar = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6
    want = {(a, b) for s, parts, m in ((2, 3, 23), (6, 30, 50)) for a in range(m) for b in range(a + 1, m) if a % parts != b % parts and similar(a, b)}

    def roots(pairs):
        root = {k: k for k in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {k: find(k) for k in sets}

    assert set(got) <= want and len(got) == len(set(got)) and roots(got) == roots(want) and len(want) > 100
    if block == 50:
        assert len(got) <= 23 + 50


def test_common_counts(monkeypatch):
    monkeypatch.setattr(overlap, "COLUMNS", 5)
    rng = random.Random(1)
    sets = [rng.sample(range(60), rng.randint(0, 30)) for _ in range(20)]
    counts = overlap.common_counts(pa.array(sets, pa.list_(pa.int64())))
    assert counts.tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets]


def test_what_scans_make_is_not_broadcast(spark, monkeypatch):
    """Shingles and grid rows are made by scans, of which no file tells; so no broadcast is planned, however small the files."""
    plans = {}
    plan = lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()})
    write = overlap.shared_table
    for module in (overlap, simhash):
        monkeypatch.setattr(module, "shared_table", lambda df, name: plan(df, name) or write(df, name))
    rows = corpus(6)
    docs = write(spark.createDataFrame(rows, "doc_id long, text string"), "documents")
    kept = dict(importlib.import_module("corpus_pipeline").STAGES)["near-duplicate removal"](spark, docs, "")
    plan(kept, "kept rows")
    assert {r["doc_id"] for r in kept.collect()} == set(brute(rows).values())
    assert all("SortMergeJoin" in plans[n] and "Broadcast" not in plans[n] for n in ("grid-pairs", "kept rows"))
