"""Filling fixed-capacity containers with items by a grouping genetic algorithm.

Items are word counts, so a document is a histogram of at most ``capacity``
lengths and a total for the blocks that may be cut. Genes are whole containers:
crossover injects well-filled containers of one parent into the other, removes
containers that now hold a duplicate and puts their displaced items back by best
fit. Documents of very many blocks evolve in the same way with equal containers
counted together, so that all their blocks take part at any length, from a packing rounded out of the
linear relaxation. Populations evolve on islands, one task row each, whose
elites migrate round a ring between epochs. A document leaves as soon as it
reaches the lower bound, which proves that it is optimal.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, ship_package

Bin = tuple[int, ...]


def lower_bound(lengths: Iterable[int] | Mapping[int, int], capacity: int, most_k: int = 12) -> int:
    """Fewest containers that any packing of lengths, or of a histogram of them, needs.

    Largest value of a family of dual feasible functions: lengths below a limit
    count as 0 and their complements as whole containers, and what remains is
    rounded to k-ths of a container (for k = 1: the bound of Martello and Toth).
    """
    counts = sorted(Counter(lengths).items(), reverse=True)
    best = -(-sum(n * k for n, k in counts) // capacity)
    for limit in {0, *(n for n, _ in counts if 2 * n <= capacity)}:
        whole = sum(k for n, k in counts if n > capacity - limit)
        middle = [(n, k) for n, k in counts if limit <= n <= capacity - limit]
        best = max(best, whole + -(-sum(n * k for n, k in middle) // capacity))
        for part in range(1, most_k + 1):
            # In units of capacity * part, to stay in integers.
            units = sum((n * part if (part + 1) * n % capacity == 0 else (part + 1) * n // capacity * capacity) * k for n, k in middle)
            best = max(best, whole + -(-units // (capacity * part)))
    return best


def best_fit(items: Iterable[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Put items, largest first, each into the fullest container that still takes it."""
    bins = bins if bins is not None else []
    free = sorted((capacity - sum(b), i) for i, b in enumerate(bins))
    for n in sorted(items, reverse=True):
        at = bisect_left(free, (n, -1))
        if at == len(free):
            bins.append([n])
            insort(free, (capacity - n, len(bins) - 1))
        else:
            room, i = free.pop(at)
            bins[i].append(n)
            insort(free, (room - n, i))
    return bins


def fill(room: int, items: list[int]) -> list[int]:
    """Items whose sum comes closest to ``room`` from below (subset sums as bits of one integer)."""
    reach = [1]
    mask = (1 << (room + 1)) - 1
    for n in items:
        reach.append((reach[-1] | reach[-1] << n) & mask)
    target = reach[-1].bit_length() - 1
    chosen = []
    for i in range(len(items) - 1, -1, -1):
        if not reach[i] >> target & 1:
            chosen.append(items[i])
            target -= items[i]
    return chosen


def slack_fit(items: Iterable[int], capacity: int, rng: random.Random | None = None) -> list[list[int]]:
    """Containers closed one by one: the largest item, filled up as far as the rest allows.

    With ``rng`` ties between equally full subsets fall at random.
    """
    rest = sorted(items, reverse=True)
    bins = []
    while rest:
        first = rest.pop(0 if rng is None or rng.random() < 0.8 else rng.randrange(len(rest)))
        order = list(rest)
        if rng is not None:
            rng.shuffle(order)
        chosen = fill(capacity - first, order)
        for n in chosen:
            rest.remove(n)
        bins.append([first, *chosen])
    return bins


def close_pairs(lengths: dict[int, int], capacity: int) -> int:
    """Take pairs that fill a container exactly out of a histogram; gives their number.

    Some best packing holds every such pair: what shares its two containers with
    the halves fits into one. So huge groups become short without losing the
    optimum.
    """
    closed = lengths.pop(capacity, 0)
    for n in sorted(lengths):
        m = capacity - n
        k = lengths[n] // 2 if n == m else min(lengths[n], lengths.get(m, 0)) if n < m else 0
        if k:
            closed += k
            lengths[n] -= k
            lengths[m] -= k
    return closed


def fitness(bins: list[list[int]], capacity: int) -> float:
    """Mean squared filling: among packings of equal size the one with fuller containers is better."""
    return sum((sum(b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def _replace(bins: list[list[int]], displaced: list[int], capacity: int) -> list[list[int]]:
    """Best fit of displaced items after trading pairs of small items for one larger (dominance)."""
    displaced.sort(reverse=True)
    for b in bins:
        room = capacity - sum(b)
        for k, n in enumerate(displaced):
            swap = max((x for x in b if x < n <= x + room), default=None)
            if swap is not None:
                b.remove(swap)
                b.append(n)
                displaced[k] = swap
                room -= n - swap
    return best_fit(displaced, capacity, bins)


def crossover(a: list[list[int]], b: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Child of ``a`` with the better-filled half of a sample of ``b``'s containers injected whole."""
    sample = sorted(rng.sample(b, max(1, len(b) // 2)), key=sum, reverse=True)
    injected = [list(x) for x in sample[: max(1, len(sample) // 2)]]
    surplus = Counter(n for x in injected for n in x)
    kept, displaced = [], []
    for x in sorted(a, key=sum, reverse=True):
        own = Counter(x)
        if own & surplus:  # a duplicate: the container goes, what isn't duplicate is displaced
            displaced += (own - surplus).elements()
            surplus -= own & surplus
        else:
            kept.append(list(x))
    return _replace(injected + kept, displaced, capacity)


def mutate(bins: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empty a few of the least filled containers and fit their items again."""
    order = sorted(bins, key=lambda x: (sum(x), rng.random()))
    k = min(len(order), rng.randint(1, 3))
    gone = order[:k] + ([rng.choice(order[k:])] if len(order) > k else [])
    left = list(map(list, order[k:]))
    if len(order) > k:
        left.remove(list(gone[-1]))
    displaced = [n for x in gone for n in x]
    if rng.random() < 0.7:
        return left + slack_fit(displaced, capacity, rng)
    rng.shuffle(displaced)
    return _replace(left, displaced, capacity)


def best_fit_counts(counts: Mapping[int, int], capacity: int, bins: Mapping[Bin, int] | None = None) -> Counter[Bin]:
    """``best_fit`` of a histogram into containers with their number: equal ones are filled together, so it costs the same for any number of blocks."""
    rooms: dict[int, Counter[Bin]] = {}

    def put(b: Bin, k: int) -> None:
        if k:
            rooms.setdefault(capacity - sum(b), Counter())[tuple(sorted(b, reverse=True))] += k

    for b, k in (bins or {}).items():
        put(b, k)
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in rooms if r >= n), default=capacity)
            b, k = rooms[room].popitem() if room in rooms else ((), left)
            if not rooms.get(room, True):
                del rooms[room]
            each = room // n
            whole = min(k, left // each)
            put(b + (n,) * each, whole)
            left -= whole * each
            if whole < k:
                if left:
                    put(b + (n,) * left, 1)
                if b:
                    put(b, k - whole - bool(left))
                left = 0
    return sum(rooms.values(), Counter())


def slack_fit_counts(counts: Mapping[int, int], capacity: int, rng: random.Random | None = None) -> Counter[Bin]:
    """``slack_fit`` of a histogram: each way to fill a container is used as often as the rest allows."""
    rest = Counter({n: k for n, k in counts.items() if k > 0})
    bins: Counter[Bin] = Counter()
    while rest:
        first = max(rest) if rng is None or rng.random() < 0.8 else rng.choice(list(rest))
        order = [n for n in sorted(rest, reverse=True) for _ in range(min(rest[n] - (n == first), (capacity - first) // n))]
        if rng is not None:
            rng.shuffle(order)
        b = tuple(sorted([first, *fill(capacity - first, order)], reverse=True))
        own = Counter(b)
        times = min(rest[n] // k for n, k in own.items())
        bins[b] += times
        rest -= Counter({n: k * times for n, k in own.items()})
    return bins


def fitness_counts(bins: Mapping[Bin, int], capacity: int) -> float:
    """``fitness`` of containers with their number."""
    return sum(k * (sum(b) / capacity) ** 2 for b, k in bins.items()) / max(1, sum(bins.values()))


def _replace_counts(bins: Counter[Bin], displaced: Counter[int], capacity: int) -> Counter[Bin]:
    """``_replace`` of containers and displaced items with their number."""
    for b, k in list(bins.items()):
        for n in sorted(displaced, reverse=True):
            swap = max((x for x in b if x < n <= x + capacity - sum(b)), default=None)
            if swap is not None:
                k = min(k, displaced[n])
                other = list(b)
                other.remove(swap)
                bins[b] -= k
                b = tuple(sorted([*other, n], reverse=True))
                bins[b] += k
                displaced[swap] += k
                displaced[n] -= k
                displaced = +displaced
    return best_fit_counts(displaced, capacity, +bins)


def crossover_counts(a: Counter[Bin], b: Counter[Bin], capacity: int, rng: random.Random) -> Counter[Bin]:
    """``crossover`` of containers with their number."""
    sample = sorted(rng.sample(list(b), max(1, len(b) // 2)), key=sum, reverse=True)
    child = Counter({x: b[x] for x in sample[: max(1, len(sample) // 2)]})
    surplus: Counter[int] = Counter()
    for x, k in child.items():
        for n in x:
            surplus[n] += k
    displaced: Counter[int] = Counter()
    for x in sorted(a, key=sum, reverse=True):
        own = Counter(x)
        broken = min(a[x], max(-(-surplus[n] // k) for n, k in own.items()))
        gone = Counter({n: broken * k for n, k in own.items()})
        displaced += gone - surplus
        surplus -= gone & surplus
        child[x] += a[x] - broken
    return _replace_counts(+child, displaced, capacity)


def mutate_counts(bins: Counter[Bin], capacity: int, rng: random.Random) -> Counter[Bin]:
    """``mutate`` of containers with their number: some or all of the equal ones are emptied."""
    order = sorted(bins, key=lambda b: (sum(b), rng.random()))
    left = Counter(bins)
    displaced: Counter[int] = Counter()
    for b in {*order[: rng.randint(1, 3)], rng.choice(order)}:
        k = left[b] if rng.random() < 0.5 else rng.randint(1, left[b])
        left[b] -= k
        for n in b:
            displaced[n] += k
    if rng.random() < 0.7:
        return +left + slack_fit_counts(displaced, capacity, rng)
    return _replace_counts(+left, displaced, capacity)


def evolve(items: list[int] | Counter[int], capacity: int, bound: int, seed: int, generations: int = 30, population: int = 12, elites: list | None = None) -> list[list[int]] | Counter[Bin]:
    """Best packing of one island after ``generations``, or as soon as the bound is met.

    Items of a histogram are packed as containers with their number.
    """
    rng = random.Random(seed)
    if isinstance(items, Counter):
        fit, close, cross, change, full, size, copy = best_fit_counts, slack_fit_counts, crossover_counts, mutate_counts, fitness_counts, Counter.total, Counter
    else:
        fit, close, cross, change, full, size, copy = best_fit, slack_fit, crossover, mutate, fitness, len, lambda e: list(map(list, e))
    pool = [copy(e) for e in elites or []]
    pool.append(fit(items, capacity))
    rank = lambda p: (size(p), -full(p, capacity))
    best = min(pool, key=rank)
    if size(best) <= bound:
        return best
    if not elites:
        pool.append(close(items, capacity))
        while len(pool) < population // 2 and size(pool[-1]) > bound:
            pool.append(close(items, capacity, rng))
    while len(pool) < population and size(pool[-1]) > bound:
        pool.append(change(pool[0] if rng.random() < 0.5 else rng.choice(pool), capacity, rng))
    for _ in range(generations):
        pool.sort(key=rank)
        if size(pool[0]) <= bound:
            break
        parents = pool[: population // 2]
        children = [cross(*rng.sample(parents, 2), capacity, rng) if len(parents) > 1 else change(parents[0], capacity, rng) for _ in range(population // 3)]
        children += [change(rng.choice(parents), capacity, rng) for _ in range(population - len(parents) - len(children))]
        pool = parents + children
    return min(pool, key=rank)


def _dearest(lengths: list[int], prices: list, capacity: int) -> tuple:
    """Highest total price of what fits into a container, and how often it holds each length."""
    n, y = np.array(lengths), np.array(prices)
    value, last = np.zeros(capacity + 1, y.dtype), [-1] * (capacity + 1)
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        fits = np.flatnonzero(n <= c)
        if len(fits):
            sums = value[c - n[fits]] + y[fits]
            k = int(sums.argmax())
            if sums[k] > value[c]:
                value[c], last[c] = sums[k], int(fits[k])
    held, c = [0] * len(lengths), capacity
    while c > 0:
        k = last[c]
        if k < 0:
            c -= 1
        else:
            held[k] += 1
            c -= lengths[k]
    return value[capacity], held


def relaxed(counts: Counter[int], capacity: int, seed: int = 0, steps: int = 5000) -> tuple[int, Counter[Bin]]:
    """A lower bound and a packing by the linear relaxation over all ways to fill a container (columns as they pay).

    The bound is taken from the prices in whole numbers, so no rounding touches
    it, and holds wherever the steps end. The packing is the relaxation rounded
    down, what that leaves being packed by ``evolve``.
    """
    lengths = sorted((n for n, k in counts.items() if k > 0), reverse=True)
    need = np.array([counts[n] for n in lengths], float)
    basis = np.diag([float(capacity // n) for n in lengths])
    used, prices = need / basis.diagonal(), 1 / basis.diagonal()
    for _ in range(steps):
        prices = np.linalg.solve(basis.T, np.ones(len(lengths)))
        price, held = _dearest(lengths, list(prices), capacity)
        if price <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, np.array(held, float))
        ratio = np.full(len(lengths), np.inf)
        np.divide(used, step, out=ratio, where=step > 1e-7)
        k = int(ratio.argmin())
        used = np.maximum(used - ratio[k] * step, 0)
        used[k] = ratio[k]
        basis[:, k] = held
    whole = [max(0, int(y * 2**40)) for y in prices]
    bound = -(-sum(y * counts[n] for y, n in zip(whole, lengths)) // int(_dearest(lengths, whole, capacity)[0]))
    bins: Counter[Bin] = Counter()
    rest = Counter({n: counts[n] for n in lengths})
    for k, x in enumerate(np.linalg.solve(basis, need)):
        own = Counter({n: round(m) for n, m in zip(lengths, basis[:, k]) if m > 0.5})
        times = min([max(0, int(x + 1e-6)), *(rest[n] // m for n, m in own.items())])
        bins[tuple(own.elements())] += times
        rest -= Counter({n: m * times for n, m in own.items()})
    left = evolve(list(rest.elements()), capacity, bound - bins.total(), seed)
    return bound, +bins + Counter(tuple(sorted(b, reverse=True)) for b in left)


def exact_count(items: list[int], capacity: int, bound: int, best: int, budget: int = 50_000) -> int:
    """Whether fewer than ``best`` containers do, by bin completion; gives ``best`` when the budget of steps ends.

    Containers are closed one by one round the largest item left; none may waste
    more than what ``best - 1`` containers can waste in all.
    """
    items = sorted(items, reverse=True)
    steps = [budget]

    def close(rest: list[int], slack: int) -> bool:
        if not rest:
            return True
        first, others = rest[0], rest[1:]
        room = capacity - first
        tails = [0] * (len(others) + 1)
        for i in range(len(others) - 1, -1, -1):
            tails[i] = tails[i + 1] + others[i]

        def choose(i: int, room: int, kept: list[int]) -> bool:
            steps[0] -= 1
            if steps[0] < 0 or room - tails[i] > slack:
                return False
            if i == len(others):
                return close(kept, slack - room)
            n = others[i]
            if n <= room and choose(i + 1, room - n, kept):
                return True
            j = i
            while j < len(others) and others[j] == n:
                j += 1
            return choose(j, room, kept + others[i:j])

        return choose(0, room, [])

    while best > bound and len(items) <= 150:
        slack = (best - 1) * capacity - sum(items)
        if slack < 0 or not close(items, slack):
            break
        best -= 1
    return best


def _pairs(counts: Mapping[int, int]) -> list[dict]:
    return [{"n": n, "k": k} for n, k in counts.items() if k]


def _packed(bins: list[list[int]] | Counter[Bin]) -> list[dict]:
    return [{"b": list(b), "k": k} for b, k in (bins.items() if isinstance(bins, Counter) else ((b, 1) for b in bins))]


def _items(pairs: Iterable, active: int) -> list[int] | Counter[int]:
    """Item by item, or as a histogram above ``active`` items."""
    counts = Counter({int(p["n"]): int(p["k"]) for p in pairs})
    return counts if counts.total() > active else list(counts.elements())


def _start(frames: Iterator[pd.DataFrame], capacity: int, active: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for key, pairs, uncut in zip(f["document_id"], f["lengths"], f["cuttable"]):
            lengths = {int(p["n"]): int(p["k"]) for p in pairs} if pairs is not None else {}
            whole = dict(lengths)
            closed = close_pairs(lengths, capacity)
            items = _items(_pairs(lengths), active)
            bins = _packed(best_fit_counts(items, capacity) if isinstance(items, Counter) else best_fit(items, capacity))
            loose = int(uncut)
            # Cuttable words fill any gap, so nothing below this count matters.
            need = -(-(sum(n * k for n, k in lengths.items()) + loose) // capacity)
            bound, count = max(lower_bound(lengths, capacity), need), sum(b["k"] for b in bins)
            if count > bound:
                bound = max(bound, lower_bound(whole, capacity) - closed)
            if count > bound and isinstance(items, Counter):
                least, other = relaxed(items, capacity)
                bound = max(bound, least)
                if other.total() < count:
                    bins, count = _packed(other), other.total()
            rows.append((key, _pairs(lengths), closed, loose, bound, bins, count <= bound))
        yield pd.DataFrame(rows, columns=["document_id", "items", "closed", "loose", "bound", "bins", "done"])


def _island(frames: Iterator[pd.DataFrame], capacity: int, epoch: int, generations: int, active: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        bins = []
        for pairs, bound, island, *elites in zip(f["items"], f["bound"], f["island"], f["own"], f["visitor"]):
            items = _items(pairs, active)
            elites = [e for e in elites if e is not None]
            if isinstance(items, Counter):
                own = [Counter({tuple(int(n) for n in b["b"]): int(b["k"]) for b in e}) for e in elites]
            else:
                own = [[[int(n) for n in b["b"]] for b in e] for e in elites]
            bins.append(_packed(evolve(items, capacity, int(bound), seed=epoch * 7919 + int(island), generations=generations, elites=own)))
        yield f.assign(bins=bins)[["document_id", "items", "closed", "loose", "bound", "island", "bins"]]


def _prove(frames: Iterator[pd.DataFrame], capacity: int, active: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        n, sure = [], []
        for pairs, bound, k in zip(f["items"], f["bound"], f["n_bins"]):
            items, bound, k = _items(pairs, active), int(bound), int(k)
            if not isinstance(items, Counter):
                k = exact_count(items, capacity, bound, k)
                if k > bound:  # the relaxation over whole containers bounds more closely, and may itself pack into fewer
                    least, other = relaxed(Counter(items), capacity)
                    bound, k = max(bound, least), min(k, other.total())
            n.append(k)
            sure.append(k <= bound)
        yield f.assign(n_bins=n, proved=sure)[["document_id", "closed", "loose", "items", "n_bins", "proved"]]


_ITEMS, _BINS = "ARRAY<STRUCT<n: INT, k: BIGINT>>", "ARRAY<STRUCT<b: ARRAY<INT>, k: BIGINT>>"
STATE = f"document_id STRING, items {_ITEMS}, closed BIGINT, loose BIGINT, bound INT, bins {_BINS}, done BOOLEAN"
ISLAND = f"document_id STRING, items {_ITEMS}, closed BIGINT, loose BIGINT, bound INT, island INT, bins {_BINS}"


def block_lengths(blocks: DataFrame, capacity: int = 200) -> DataFrame:
    """``document_id, lengths ARRAY<STRUCT<n, k>>, cuttable``: histogram of block lengths in words.

    Words are blank-separated pieces; null and empty texts have none and need no
    room. A block delivered twice counts once. Counts are summed before they are
    gathered, so that one document of any number of blocks is one short row.
    """
    words = F.coalesce(F.regexp_count("clean_text", F.lit(r"\S+")), F.lit(0)).cast("int")
    once = blocks.where(F.col("document_id").isNotNull()).select("document_id", "block_id", words.alias("n")).groupBy("document_id", "block_id").agg(F.max("n").alias("n"))
    counted = once.groupBy("document_id", "n").agg(F.count(F.lit(1)).alias("k"))
    fits = F.col("n").between(1, capacity)
    # An explicit number of tasks, here and below: packing is work for the processor, and adaptive execution would put these few bytes into one task.
    return counted.repartition(_tasks(blocks.sparkSession), "document_id").groupBy("document_id").agg(F.collect_list(F.when(fits, F.struct("n", "k"))).alias("lengths"), F.coalesce(F.sum(F.when(F.col("n") > capacity, F.col("n") * F.col("k"))), F.lit(0)).alias("cuttable"))


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def packings(blocks: DataFrame, capacity: int = 200, islands: int = 4, epochs: int = 4, generations: int = 25, active: int = 600) -> DataFrame:
    """``document_id, n_containers, proved``: the fewest containers found for each document, and whether fewer are known to be impossible.

    Documents with no word need no container. Blocks longer than ``capacity`` are
    cut between words and so fill gaps; no other block is cut. With more than
    ``active`` blocks left to pack, a document evolves as containers with their
    number instead of one by one. Rows with a null document_id are left out.
    """
    spark = blocks.sparkSession
    ship_package(spark)
    tasks = _tasks(spark)
    state = materialize(block_lengths(blocks, capacity).mapInPandas(lambda fs: _start(fs, capacity, active), STATE), "packing")
    number = lambda bins: F.aggregate(bins, F.lit(0).cast("long"), lambda a, x: a + x["k"])
    done = state.where("done").select("document_id", "closed", "loose", "items", number("bins").alias("n_bins"), F.lit(True).alias("proved"))
    same = ["document_id", "items", "closed", "loose", "bound"]
    open_ = state.where(~F.col("done"))
    grown = open_.select(*same, F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("bins").alias("own"), F.lit(None).cast(_BINS).alias("visitor"))
    tables = []
    for epoch in range(epochs):
        evolved = grown.repartition(tasks, "document_id", "island").mapInPandas(lambda fs, e=epoch: _island(fs, capacity, e, generations, active), ISLAND)
        # The islands of a document come together in one short row, whose elites then move round the ring: island i also starts from the best of island i - 1.
        ring = F.array_sort(F.collect_list(F.struct("island", "bins")))
        together = materialize(evolved.groupBy("document_id").agg(*[F.first(c).alias(c) for c in same[1:]], ring.alias("ring")).withColumn("n_bins", F.array_min(F.transform("ring", lambda x: number(x["bins"])))), "packing-epoch")
        tables.append(together)
        done = done.unionByName(together.where("n_bins <= bound").select("document_id", "closed", "loose", "items", "n_bins", F.lit(True).alias("proved")))
        open_ = together.where("n_bins > bound")
        if open_.isEmpty():
            break
        grown = open_.select(*same, "ring", F.posexplode("ring").alias("at", "one")).select(*same, F.col("one.island").alias("island"), F.col("one.bins").alias("own"), F.col("ring")[F.pmod(F.col("at") - 1, F.size("ring"))]["bins"].alias("visitor"))
    else:
        rest = open_.select("document_id", "closed", "loose", "items", "bound", "n_bins").repartition(tasks, "document_id")
        done = done.unionByName(rest.mapInPandas(lambda fs: _prove(fs, capacity, active), f"document_id STRING, closed BIGINT, loose BIGINT, items {_ITEMS}, n_bins BIGINT, proved BOOLEAN"))
    words = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["n"] * x["k"]) + F.col("loose")
    needed = F.ceil(words / capacity)
    count = F.col("closed") + F.greatest(F.col("n_bins"), needed)
    result = materialize(done.select("document_id", count.cast("int").alias("n_containers"), (F.col("proved") | (needed >= F.col("n_bins"))).alias("proved")), "packed")
    discard(state, *tables)
    return result


def pack(blocks: DataFrame, capacity: int = 200, **options: int) -> DataFrame:
    """``document_id, n_containers``: the fewest containers found for each document (see ``packings``)."""
    return packings(blocks, capacity, **options).select("document_id", "n_containers")
