import itertools
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from retainly.llm import reshard

from .helpers import awkward, frame


def check(rows, shards):
    """The law, gapless slots and the fewest bytes for rows of assign()."""
    counts = Counter(r.shard for r in rows)
    n = [counts.get(s, 0) for s in range(shards)]
    assert set(counts) <= set(range(shards)) and max(n) - min(n) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    moved = sum(r.size for r in rows if r.old_shard != r.shard)
    assert moved == fewest(rows, shards)


def fewest(rows, shards):
    """Brute force over which shards take one row more; the smallest rows of a full shard leave."""
    old = defaultdict(list)
    for r in rows:
        old[r.old_shard].append(r.size)
    least, more = divmod(len(rows), shards)
    best = None
    for extra in itertools.combinations(range(shards), more):
        cost = 0
        for s, sizes in old.items():
            room = (least + (s in extra)) if s is not None and 0 <= s < shards else 0
            cost += sum(sorted(sizes)[: max(0, len(sizes) - room)])
        best = cost if best is None else min(best, cost)
    return best


def rows_frame(spark, rows):
    return frame(spark, rows, "old_shard int, doc_id bigint, size bigint, text_crc32 bigint")


def test_fewest_bytes_and_one_apart(spark):
    for seed in range(4):
        rng = random.Random(seed)
        old, new = rng.choice([(3, 5), (6, 4), (5, 5), (2, 7)])
        rows = [(0 if rng.random() < 0.5 else rng.randrange(old), i, rng.choice([8, 8, 20, 500, rng.randint(9, 4000)]), rng.randrange(2**32)) for i in range(rng.randint(1, 150))]
        check(reshard.assign(rows_frame(spark, rows), new).collect(), new)


def test_the_marginal_rows_sizes_decide(spark):
    """Sizes of one class: by class averages the flow would take the wrong shard's row."""
    sizes = {0: [1024, 1279, 1279], 1: [1100, 1100, 1100], 2: [50]}
    rows = [(s, i, size, i) for s, own in sizes.items() for i, size in enumerate(own)]
    got = reshard.assign(rows_frame(spark, rows), 3).collect()
    check(got, 3)
    assert sum(r.size for r in got if r.old_shard != r.shard) == 1024


def test_fewest_bytes_over_many_small_cases():
    class Row:
        def __init__(self, old_shard, size):
            self.old_shard, self.size = old_shard, size

    rng = random.Random(9)
    for _ in range(300):
        shards = rng.randint(1, 6)
        rows = [Row(rng.choice([-1, 0, 0, 0, 1, 2, 3, 7]), rng.choice([rng.randint(1, 30), rng.randint(1000, 1300)])) for _ in range(rng.randint(1, 40))]
        own = defaultdict(list)
        for r in rows:
            own[r.old_shard].append(r.size)
        least = len(rows) // shards
        over = {s: len(v) - (least if 0 <= s < shards else 0) for s, v in own.items()}
        over = {s: n for s, n in over.items() if n > 0}
        moves = reshard.solve(reshard.margins({s: len(v) for s, v in own.items()}, over, {s: sorted(own[s])[n - 1] for s, n in over.items()}), shards)
        give = Counter()
        for (s, _), n in moves.items():
            give[s] += n
        assert sum(sum(sorted(own[s])[:n]) for s, n in give.items()) == fewest(rows, shards)


def test_sizes_at_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.choice([0, 1, 8, rng.randint(1, 100), rng.randint(10**5, 10**7)])) for _ in range(400)]
    keyed = frame(spark, rows, "old int, size bigint")
    own = {s: sorted(x for o, x in rows if o == s) for s in range(3)}
    classes = defaultdict(Counter)
    for r in keyed.select("old", reshard.size_class(F.col("size")).alias("b")).collect():
        classes[r.old][r.b] += 1
    for k in (1, 17, 60, 100):
        assert reshard.at_rank(keyed, classes, {s: k for s in own}) == {s: (v[k - 1], k - v.index(v[k - 1])) for s, v in own.items()}


def test_flow_alone():
    moves = reshard.solve({0: [(10, 6), (1, 4)], 1: [(5, 1)]}, 3)
    assert sum(moves.values()) == 6 and all(a == 0 for a, _ in moves)


def test_sizes_and_awkward_rows(spark):
    docs = awkward(spark)
    got = reshard.assign(reshard.sized(docs, F.lit(3)), 4).collect()
    texts = [(r.text or "").encode() for r in docs.collect()]
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(t) + 8, zlib.crc32(t)) for t in texts)
    check(got, 4)
    check(reshard.assign(reshard.sized(docs, F.lit(None)), 4).collect(), 4)
    assert reshard.assign(reshard.sized(docs.limit(0), F.lit(0)), 4).count() == 0


def test_rewrite_writes_the_affected_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "text " * (i % 7), "s0" if i < 30 else "s1") for i in range(40)], "doc_id bigint, text string, source string")
    old = F.when(F.col("source") == "s0", 0).otherwise(1)
    placed = reshard.assign(reshard.sized(docs, old), 3)
    affected = reshard.rewrite(docs, old, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.shard, r.slot) for r in placed.collect() if r.shard in affected}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == want and set(affected) == {0, 1, 2}
    assert {r.text for r in back.where("doc_id = 5").collect()} == {"text " * 5}
