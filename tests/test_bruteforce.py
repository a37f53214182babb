"""
random rows, against the Spark operators. Nothing here is shared with the DuckDB
statements."""

import datetime as dt
import random
import statistics
from collections import Counter, defaultdict

import pytest

from opsmetrics import rules
from opsmetrics.operators import allocation, cycle, filters, ingest, volume, workload
from opsmetrics.sources import existing_keys

OPS_SCHEMA = "file string, tipo string, operativo string, estado string, fecha_file timestamp_ntz, fecha_cierre timestamp_ntz"


def random_ops(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = dt.datetime(2023, 1, 1) + dt.timedelta(hours=rng.randrange(0, 24 * 400))
        close = start + dt.timedelta(hours=rng.randrange(-30, 24 * 150)) if rng.random() < 0.6 else None
        rows.append(
            (
                f"F{i}",
                rng.choice(["A", "M", "F", "B", "S", "T", "C", "Z", None]),
                rng.choice([f"o{k}" for k in range(12)] + [None]),
                rng.choice(["CERRADO", "Cerrado", "ABIERTO", None]),
                start,
                close,
            )
        )
    return rows


def is_open_row(state):
    return state is None or state.upper() != "CERRADO"


def whole_days(start, end):
    """Days between, or None if not closed or closed before it began."""
    if start is None or end is None or end < start:
        return None
    return (end - start).days


def half_even(value, digits):
    return round(value * 10**digits) / 10**digits


class Desk:
    """What is known of one owner and one type."""

    def __init__(self):
        self.open = 0
        self.days = []
        self.in_time = 0

    def take(self, row):
        _, kind, _, state, start, end = row
        self.open += is_open_row(state)
        days = whole_days(start, end)
        if days is not None:
            self.days.append(days)
            self.in_time += kind in rules.STANDARD_DAYS and days <= rules.STANDARD_DAYS[kind]


def guide_by_hand(rows):
    desks = defaultdict(Desk)
    for row in rows:
        desks[row[2], row[1]].take(row)
    owners = {o for o, _ in desks if o is not None}
    kinds = {k for _, k in desks if k is not None}
    speeds = {}
    for kind in kinds:
        seen = {o: statistics.fmean(desks[o, kind].days) for o in owners if (o, kind) in desks and desks[o, kind].days}
        usual = statistics.fmean(seen.values()) if seen else None
        for owner in owners:
            speeds[owner, kind] = seen.get(owner, usual)
    known = [v for v in speeds.values() if v is not None]
    fallback = statistics.fmean(known) if known else rules.DEFAULT_SPEED_DAYS
    out = {}
    for (owner, kind), speed in speeds.items():
        desk = desks.get((owner, kind), Desk())
        spare = max(rules.IDEAL_PER_MONTH.get(kind, 0) - desk.open, 0)
        if spare:
            speed = fallback if speed is None else speed
            success = half_even(100 * desk.in_time / len(desk.days), 1) if desk.days else rules.DEFAULT_EFFICACY
            out[owner, kind] = (spare, speed, success, spare / (speed + 1) * 100 * (1 + success / 100))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_allocation_guide_by_hand(spark, seed):
    rows = random_ops(seed)
    want = guide_by_hand(rows)
    got = {
        (r.operativo, r.tipo): (r.cargas_posibles_adicionales, r.velocidad_promedio_dias, r.eficacia_historica, r.indice_estrategico)
        for r in allocation.allocation_guide(spark.createDataFrame(rows, OPS_SCHEMA)).collect()
    }
    assert set(got) == set(want)
    for key, (spare, speed, success, index) in want.items():
        assert got[key][0] == spare and got[key][2] == success
        assert got[key][1] == pytest.approx(speed, abs=1e-8)
        assert got[key][3] == pytest.approx(index, abs=0.0051)


@pytest.mark.parametrize("seed, n", [(1, 15), (2, 4), (3, 400), (4, 1)])
def test_top_allocations_without_the_grid(spark, seed, n):
    ops = spark.createDataFrame(random_ops(seed, 40 if n < 10 else 300), OPS_SCHEMA)
    want = allocation.allocation_top(allocation.allocation_guide(ops, sort=False), n)
    top = allocation.top_allocations(ops, n)
    assert sorted(map(tuple, top.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_grid_is_made_once_and_not_at_all_for_the_top(spark):
    ops = spark.createDataFrame(random_ops(5), OPS_SCHEMA)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    exploded = "Generate explode("
    assert plan(workload.available_capacity(ops)).count(exploded) == plan(allocation.allocation_guide(ops)).count(exploded) > 0
    assert exploded not in plan(allocation.top_allocations(ops))


def test_top_allocations_with_few_pairs(spark):
    rows = [("F1", "A", "o1", "ABIERTO", dt.datetime(2024, 1, 1), None), ("F2", None, "o2", "ABIERTO", dt.datetime(2024, 1, 1), None)]
    rows += [("F3", "M", None, "CERRADO", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9))]
    for given in (rows, rows[:1], []):
        ops = spark.createDataFrame(given, OPS_SCHEMA)
        want = sorted(map(tuple, allocation.allocation_guide(ops).collect()))
        assert sorted(map(tuple, allocation.top_allocations(ops).collect())) == want
    assert len(allocation.allocation_guide(spark.createDataFrame(rows, OPS_SCHEMA)).collect()) == 4


def test_capacity_of_twenty_thousand_types(spark):
    rows = [(f"F{i}", f"T{i}", f"o{i % 2}", "ABIERTO", dt.datetime(2024, 1, 1), None) for i in range(20_000)]
    out = workload.available_capacity(spark.createDataFrame(rows, OPS_SCHEMA))
    assert out.count() == 40_000
    assert out.distinct().count() == 40_000


def random_upload(seed, n=200):
    rng = random.Random(seed)
    pads = ["", " ", " ", "\t", "　"]
    rows = []
    for i in range(n):
        key = rng.choice([f"k{rng.randrange(60)}", "nan", "None", "NA", "", None])
        if key is not None:
            key = rng.choice(pads) + (key.upper() if rng.random() < 0.5 else key) + rng.choice(pads)
        rows.append((str(i), key, rng.choice(["op1", " op2 ", "na", None]), rng.choice(["c1", "NONE", None]), rng.choice(["abierto", "", None]), i))
    return rows


def shown(value):
    text = "" if value is None else value.strip().upper()
    return rules.PLACEHOLDER if text in rules.MISSING_TOKENS else text


@pytest.mark.parametrize("seed", [1, 2])
def test_upload_by_hand(spark, seed):
    rows = random_upload(seed)
    stored = [f" k{i} " for i in range(0, 60, 4)] + ["", None, "K7", "K7"]
    raw = spark.createDataFrame(rows, "`Unnamed: 0` string, File string, Operativo string, Comercial string, Estado string, _ordinal bigint")
    stored_df = spark.createDataFrame([(s,) for s in stored], "file string")

    copies = defaultdict(list)  # of each key, in sheet order
    for row in rows:
        cells = tuple(shown(v) for v in row[1:5])
        if cells[0] != rules.PLACEHOLDER:
            copies[cells[0]].append(cells)
    known = {s.strip().upper() for s in stored if s}
    fresh = [own[0] for key, own in copies.items() if key not in known]
    seen = [own[0] for key, own in copies.items() if key in known]
    repeated = [cells for own in copies.values() if len(own) > 1 for cells in own]

    result = ingest.analyze_upload(raw, stored_df)
    cells_of = lambda frame: sorted((r.file, r.operativo, r.comercial, r.estado) for r in frame.collect())
    assert cells_of(result.new) == sorted(fresh)
    assert cells_of(result.existing) == sorted(seen)
    assert cells_of(result.duplicates) == sorted(repeated)
    blanks = {name: sum(c[i] == rules.PLACEHOLDER for c in fresh) for i, name in ((1, "Operativo"), (2, "Comercial"), (3, "Estado"))}
    assert {r.campo: r.registros_faltantes for r in result.quality.collect()} == (blanks if fresh else {})
    counts = result.counts.first()
    assert (counts.nuevos, counts.existentes, counts.duplicados) == (len(fresh), len(seen), len(repeated))
    assert sorted(r.file for r in existing_keys(stored_df).collect()) == sorted(known)


@pytest.mark.parametrize("seed", [4, 5])
def test_flow_by_hand(spark, seed):
    rows = random_ops(seed, n=400)
    months = len({(r[4].year, r[4].month) for r in rows}) or 1
    totals = Counter((r[2], r[1]) for r in rows if r[1] is not None and r[2] is not None)
    want = {}
    for (owner, kind), total in totals.items():
        ideal = rules.IDEAL_PER_MONTH.get(kind, 0)
        share = 100 * (total / months) / ideal if ideal else 0
        want[owner, kind] = (total, "BAJO" if share < 70 else "MEDIO" if share < 100 else "ALTO")
    sdf = spark.createDataFrame(rows, OPS_SCHEMA)
    assert {(r.operativo, r.tipo): (r.total_general, r.nivel) for r in volume.flow_classification(sdf).collect()} == want


@pytest.mark.parametrize("seed", [4, 5])
def test_open_load_by_hand(spark, seed):
    rows = random_ops(seed, n=400)
    load = defaultdict(lambda: [0, 0])
    for _, kind, owner, state, _, _ in rows:
        if owner is not None and is_open_row(state):
            load[owner][0] += 1
            load[owner][1] += rules.EFFORT_POINTS.get(kind, 1)
    spark_load = workload.open_load_by_owner(spark.createDataFrame(rows, OPS_SCHEMA))
    assert {r.operativo: [r.cantidad_operaciones, r.esfuerzo_total] for r in spark_load.collect()} == dict(load)
    first_five = lambda i: set(sorted(load, key=lambda o: (-load[o][i], o))[:5])
    assert {r.operativo for r in workload.hidden_overload(spark_load).collect()} == first_five(1) - first_five(0)


@pytest.mark.parametrize("seed", [4, 5])
def test_cycle_times_by_hand(spark, seed):
    rows = random_ops(seed, n=400)
    closed = filters.closed_durations(spark.createDataFrame(rows, OPS_SCHEMA))
    days = {r[0]: whole_days(r[4], r[5]) for r in rows}
    days = {name: d for name, d in days.items() if d is not None}
    row_of = {r[0]: r for r in rows}

    per_owner = defaultdict(list)
    for name, d in days.items():
        if row_of[name][2] is not None:
            per_owner[row_of[name][2]].append(d)
    want = {o: (half_even(sum(v) / len(v), 1), len(v), min(v), max(v)) for o, v in per_owner.items()}
    got = {r.operativo: (r.duracion_promedio, r.cerradas, r.mas_rapido, r.mas_lento) for r in cycle.owner_performance(closed).collect()}
    assert got == want

    assert len(days) >= rules.BOTTLENECK_MIN_ROWS
    limit = statistics.quantiles(days.values(), n=5, method="inclusive")[-1]
    slow = {name for name, d in days.items() if d > limit}
    assert {r.file for r in cycle.slow_operations(closed).collect()} == slow
    causes = cycle.bottleneck_causes(cycle.slow_operations(closed.withColumn("cliente", closed["operativo"]))).collect()
    for dimension, place in (("tipo", 1), ("operativo", 2)):
        seen = Counter(row_of[name][place] for name in slow if row_of[name][place] is not None)
        top = sorted(seen.items(), key=lambda pair: (-pair[1], pair[0]))[:3]
        assert sorted((r.valor, r.operaciones) for r in causes if r.dimension == dimension) == sorted(top)
