import random

from pagewright.llm import mixing


def test_every_slot_is_within_a_block_of_its_share():
    rng = random.Random(1)
    for _ in range(40):
        weights = {f"s{i}": rng.randint(1, 30) for i in range(rng.randint(1, 9))}
        total, slots = sum(weights.values()), mixing.period(weights)
        assert sorted(x for own in slots.values() for x in own) == list(range(total))
        for s, k in weights.items():
            for t in range(total + 1):
                assert abs(sum(x < t for x in slots[s]) - k * t / total) < 1


def test_phases_keep_the_bound_until_a_source_runs_out():
    weights, blocks = {"a": 3, "b": 2, "c": 1}, {"a": 7, "b": 30, "c": 11}
    phases = mixing.plan(blocks, weights)
    order = {}
    for s, n in blocks.items():
        for b in range(n):
            p = [x for x in phases[s] if x["first"] <= b][-1]
            j = b - p["first"]
            order[p["slot"] + j // p["k"] * p["w"] + p["at"][j % p["k"]]] = s
    assert sorted(order) == list(range(48))
    starts = sorted({p["slot"] for own in phases.values() for p in own}) + [48]
    for a, b in zip(starts, starts[1:]):
        active = {s for s in blocks if any(p["slot"] == a for p in phases[s])}
        total = sum(weights[s] for s in active)
        for s in active:
            for t in range(a, b + 1):
                assert abs(sum(order[x] == s for x in range(a, t)) - weights[s] * (t - a) / total) < 1


def test_rows(spark):
    rows = [(i, "a" if i % 3 else "b", "x") for i in range(200)] + [(None, None, "y"), (7, "a", "x"), (5, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, slot string")
    got = mixing.mix(docs, block_docs=4, parts=3).collect()
    assert len(got) == 203 and len({r.position for r in got}) == 203
    weights = mixing.root_weights({"sa": sum(r[1] == "a" for r in rows), "sb": 67, "n": 2})
    phases = mixing.plan({"sa": 34, "sb": 17, "n": 1}, weights)
    for r in got:
        p = [x for x in phases["n" if r.source is None else f"s{r.source}"] if x["first"] <= r.block][-1]
        j = r.block - p["first"]
        assert r.slot == p["slot"] + j // p["k"] * p["w"] + p["at"][j % p["k"]]
        assert r.position // 4 == r.slot
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.position for r in mixing.ordered(mixing.mix(docs)).collect()] == sorted(r.position for r in mixing.mix(docs).collect())


def simulated(blocks, weights):
    """Slots of a mixture, one after the other: the released block that is due first, ties by source."""
    left, order, start = dict(blocks), [], 0
    done = {s: 0 for s in blocks}
    while any(left.values()):
        own = {s: weights[s] for s, n in left.items() if n}
        total, base, slot = sum(own.values()), {s: done[s] for s in own}, 0
        while all(left[s] for s in own):
            due = [(-(-(done[s] - base[s] + 1) * total // k), s) for s, k in own.items() if (done[s] - base[s]) * total // k <= slot]
            s = min(due)[1]
            order.append((s, done[s]))
            done[s] += 1
            left[s] -= 1
            slot += 1
        start += slot
    return order


def test_plans_against_a_simulation_slot_by_slot():
    rng = random.Random(5)
    for _ in range(60):
        blocks = {f"s{i}": rng.randint(1, 25) for i in range(rng.randint(1, 6))}
        weights = {s: rng.randint(1, 9) for s in blocks}
        phases, got = mixing.plan(blocks, weights), {}
        for s, n in blocks.items():
            for b in range(n):
                p = [x for x in phases[s] if x["first"] <= b][-1]
                j = b - p["first"]
                got[p["slot"] + j // p["k"] * p["w"] + p["at"][j % p["k"]]] = (s, b)
        assert [got[i] for i in range(sum(blocks.values()))] == simulated(blocks, weights)
