"""Conditions of contests against a version that walks over each contest's rows."""

import random

import pytest

from fieldorder.operators import failures as fl

COLUMNS = (
    "year int, round int, entrant long, team string, pred double, p_finish double, rating double, grid_position int, finish_position int, dnf int,"
    "car_pace_delta_pct double, sprint_position_rel double, circuit_appearances long, championship_pressure double, is_wet int, precip_mm double,"
    "is_street_circuit double, circuit_safety_car_rate double, quali_shuffle double, quali_spread_pct double, temp_c int, wind_ms double"
)
NAMES = [c.split()[0] for c in COLUMNS.split(",")]


def contests(seed):
    r = random.Random(seed)
    some = lambda x: None if r.random() < 0.15 else x
    rows = []
    for year in (2021, 2022):
        for rnd in (2, 7):
            n = r.choice([1, 2, 9, 14])
            own = (some(r.randint(0, 1)), some(r.random()), some(1.0), some(0.2), some(r.random()), some(r.random()), some(r.randint(5, 30)), some(3.5))
            pace = {k: some(r.choice([0.0, 0.0, 0.2, 0.3, 1.5])) for k in range(5)}
            places = r.sample(range(1, n + 1), n)
            for k in range(n):
                team = r.randint(0, 4)
                rows.append((year, rnd, k, f"t{team}", some(float(r.randint(1, 6))), some(r.random()), some(float(r.randint(0, 4))), some(k + 1), some(places[k]),
                             some(r.randint(0, 1)), pace[team], r.choice([0.5, 0.5, 0.1, None]), some(r.randint(0, 2)), some(r.random()), *own))
    return rows


def walk(rows):
    out = {}
    for key in {r[:2] for r in rows}:
        g = [dict(zip(NAMES, r)) for r in rows if r[:2] == key]
        g.sort(key=lambda x: (x["pred"] is None, x["pred"] or 0, x["entrant"]))
        fav, one = g[0], g[0]
        top = sorted((x for x in g if x["rating"] is not None), key=lambda x: -x["rating"])[:5]
        pace = sorted({x["team"]: x["car_pace_delta_pct"] for x in g if x["car_pace_delta_pct"] is not None}.values())
        won = [k for k, x in enumerate(g) if x["finish_position"] == 1]
        least = [x["championship_pressure"] for x in g if x["championship_pressure"] is not None]
        seen = [x["circuit_appearances"] for x in g if x["circuit_appearances"] is not None]
        front = {x["team"] for x in g if x["grid_position"] is not None and x["grid_position"] <= 2}
        margin = None if len(g) < 2 or g[1]["pred"] is None or fav["pred"] is None else g[1]["pred"] - fav["pred"]
        out[key] = {
            "wet": one["is_wet"] == 1, "precip_mm": one["precip_mm"], "street": one["is_street_circuit"] == 1, "sc_rate": one["circuit_safety_car_rate"],
            "sprint_weekend": any(x["sprint_position_rel"] not in (None, 0.5) for x in g), "reg_reset_year": key[0] == 2022, "season_opener_3": key[1] <= 3,
            "new_circuit": bool(seen) and max(seen) <= 1, "quali_shuffle": one["quali_shuffle"], "quali_spread": one["quali_spread_pct"],
            "fav_not_on_pole": fav["grid_position"] != 1, "fav_grid": fav["grid_position"], "fav_margin": margin, "fav_p_finish": fav["p_finish"],
            "top5_rating_out_of_top6": sum((x["grid_position"] or 0) > 6 for x in top), "front_row_teammates": len(front) == 1,
            "top2_team_gap_pct": pace[1] - pace[0] if len(pace) > 1 else None, "teams_within_0_3pct": sum(p - pace[0] <= 0.3 for p in pace),
            "temp_c": one["temp_c"], "wind_ms": one["wind_ms"], "title_pressure": min(least) if least else None, "fav_dnf": fav["dnf"] == 1,
            "n_dnf": sum(x["dnf"] == 1 for x in g), "top5_rating_dnf": sum(x["dnf"] == 1 for x in top), "winner_grid": g[won[0]]["grid_position"] if won else None,
            "winner_model_rank": won[0] + 1 if won else None, "pole_dnf": any(x["grid_position"] == 1 and x["dnf"] == 1 for x in g),
        }
    return {k: {c: None if x is None else float(x) for c, x in v.items()} for k, v in out.items()}


@pytest.mark.parametrize("seed,hot", [(1, False), (2, False), (3, False), (4, True)])
def test_conditions(spark, seed, hot):
    rows = contests(seed)
    d = fl.contest_conditions(spark.createDataFrame(rows, COLUMNS).repartition(3), hot)
    got = {(r.year, r.round): {c: r[c] for c in (*fl.BEFORE, *fl.AFTER)} for r in d.collect()}
    assert got == walk(rows) and len(fl.BEFORE) + len(fl.AFTER) == 27


def test_no_contests(spark):
    d = fl.contest_conditions(spark.createDataFrame([], COLUMNS), False)
    assert d.count() == 0 and d.columns == ["year", "round", *fl.BEFORE, *fl.AFTER]
