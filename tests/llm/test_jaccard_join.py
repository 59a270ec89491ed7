import random
import time
import tracemalloc
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from veilwork.llm.exact_dedup import grace_dedup
from veilwork.llm.jaccard_join import CELL_BITS, Classes, _cells, _describe, _elements, _sign, jaccard_components, join_sets, keep_one
from veilwork.llm.store import Workspace
from veilwork.llm.text import LOWER, shingles, words


def grams(text, size):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size, t):
    sets = [grams(text, size) for _, text in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) * t.denominator >= len(a | sets[j]) * t.numerator:
                label[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(docs):
        ids = [d for j, (d, _) in enumerate(docs) if find(j) == find(i) and d is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            base = rng.choice(texts[-12:]).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 12, 40, 150, 300]))))
    docs = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (None, "one"), (1003, "one two")]
    return [(i, t) for i, t in docs]


@pytest.mark.parametrize(
    "size,t,limits",
    [
        (3, Fraction(9, 10), {}),
        (5, Fraction(4, 5), {"chunk_sets": 3, "chunk_elements": 400, "broadcast_rows": 0}),
        (1, Fraction(1, 2), {"chunk_sets": 3, "chunk_elements": 400}),
    ],
)
def test_brute_force(spark, rows, size, t, limits):
    docs = corpus(size)
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), size=size, threshold=t, **limits)
    assert rows(got) == brute(docs, size, t)


def test_pairs_of_a_large_family_are_joined_in_rounds(spark, rows, monkeypatch):
    """Chunks of three sets: pairs of chunks repeat a set many times, a round holds little more than all sets once."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(w if rng.random() > 0.05 else "x" for w in base)) for i in range(40)] + [(90, "a b c"), (91, "A b C"), (92, None)]
    made, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda space, df, name: made.append(name) or save(space, df, name))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = jaccard_components(frame, size=1, threshold=Fraction(4, 5), chunk_sets=3, round_elements=1)
    assert rows(got) == brute(docs, 1, Fraction(4, 5)) and sum(name.startswith("links") for name in made) > 3


def test_no_spent_tables_and_shuffle_files_stay(spark):
    """What a stage leaves on disk is what its rows are read from, not its texts, elements and signatures."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=8)) + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(1500)]
    docs = spark.createDataFrame([(i, texts[i // 2] + " x" * (i % 2)) for i in range(3000)], "doc_id long, text string").repartition(6)
    size = sum(len(t) for t in texts) * 2

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        sizes = 0
        while files.hasNext():
            f = files.next()
            sizes += f.length() if f.getName().startswith("shuffle_") else 0
        return sizes

    for run in (jaccard_components, grace_dedup):
        before, known = shuffled(), len(Workspace.opened)
        found = run(docs)
        until = time.time() + 20
        while shuffled() - before > size / 10 and time.time() < until:
            time.sleep(0.2)
        assert shuffled() - before <= size / 10
        left = 0
        for space in Workspace.opened[known:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(space.root)
            left += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        assert left <= size / 4, run
        assert found.count() == 3000


def test_empty_and_wordless(spark, rows):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert rows(jaccard_components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == [(1, 0, 1), (2, 0, 2)]


def test_keep_one(spark, rows):
    docs = spark.createDataFrame([(2, "a b", "x"), (1, "A B", "y"), (None, "a b", "z"), (3, "c", None)], "doc_id long, text string, gone string")
    assert rows(keep_one(docs)) == sorted([(1, "A B", "y"), (None, "a b", "z"), (3, "c", None)], key=repr)


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
def test_pairs_at_the_threshold_share_a_signature(t):
    rng, classes = np.random.default_rng(1), Classes(t)
    for n in list(range(1, 40)) + [100, 333, 1000]:
        for _ in range(20):
            base = rng.integers(0, 2**63, 2 * n + 2).astype(np.uint64)
            a = base[:n]
            for drop in range(n + 1):  # the fewest common elements that still reach the threshold
                b = np.concatenate([a[drop:], base[n : n + drop]])
                if (n - drop) * t.denominator < t.numerator * (n + drop):
                    break
                hard = b
            for common in (None, rng.random(1 << CELL_BITS) < 0.1, rng.random(1 << CELL_BITS) < 0.8):
                assert np.intersect1d(classes.signatures(np.sort(a), common), classes.signatures(np.sort(hard), common)).size


def test_trie_join_sides():
    rng = random.Random(3)
    sets = [np.unique(np.array(rng.sample(range(60), rng.randint(1, 30)), np.uint64)) for _ in range(60)]
    t = Fraction(1, 2)
    for left, right in ((sets, None), (sets[:30], sets[30:])):
        links = join_sets(left, right, t)
        for i, j in links:
            x, y = set(sets[i].tolist()), set(sets[j].tolist())
            assert 2 * len(x & y) >= len(x | y)
    hashes, at = words([b"A b  c\td", b"", b"a B"])
    assert list(at) == [0, 4, 4, 6] and hashes[0] == hashes[4] and len(shingles(hashes[4:6], 3)) == 1


def test_tasks_hold_little_more_than_a_portion():
    """Peaks of a task's own arrays over 12 MB of text: an executor's workers share what the JVM leaves."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(20_000)]
    texts = [" ".join(rng.choices(vocabulary, k=500)) for _ in range(4_000)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    common = SimpleNamespace(value=np.zeros(1 << 20, bool))
    for task in (_describe(5), _cells(5), _sign(5, Fraction(8, 10), 4, common), _elements(5)):
        tracemalloc.start()
        rows = sum(out.num_rows for out in task(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < 70e6
