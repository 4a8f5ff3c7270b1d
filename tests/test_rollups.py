"""Cubes from stored sketches against exact counts, within the sketches' bounds."""

import random

from loomgraph.operators import rollups


def test_cubes_are_exact_or_within_their_bounds(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["py", "c"]), f"v{int(rnd.paretovariate(0.5)) % 9000}" if rnd.random() > 0.02 else None, rnd.choice([rnd.randrange(1000), None])) for _ in range(20_000)]
    kind = "target string, language string, name string, size int"
    parts = [rollups.finest(spark.createDataFrame(part, kind), ["target", "language"], "name", "size") for part in (rows[:7000], rows[7000:])]
    groups = rollups.merged(parts[0].unionByName(parts[1]), ["target", "language"])
    got = {(r.level, r.target, r.language): r for r in rollups.cube(groups, ["target", "language"], (0.5, 0.9)).collect()}
    want = {}
    for target, language, name, size in rows:
        for level, key in ((0, (target, language)), (1, (target, None)), (2, (None, language)), (3, (None, None))):
            own = want.setdefault((level, *key), [0, 0, set(), []])
            own[0] += 1
            own[1] += size or 0
            own[2] |= {name} - {None}
            own[3] += [size] if size is not None else []
    assert got.keys() == want.keys() and len(got) == 6 + 3 + 2 + 1
    for key, (n, total, names, sizes) in want.items():
        r = got[key]
        assert (r.n, r.total) == (n, total)
        assert abs(r.distinct_values - len(names)) <= 3 * 1.04 / 64 * len(names) + 1
        for q, value in zip((0.5, 0.9), r.quantiles, strict=True):
            assert abs(sum(s <= value for s in sizes) / len(sizes) - q) < 0.03
