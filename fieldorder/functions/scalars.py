"""Scalar functions: parsing, normalising, small formulas. All are plain column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldorder.functions import fixed_values as fv
from fieldorder.functions.lookups import mapped

#: Accented Latin letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
BASE = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def is_dnf(status: Column) -> Column:
    """0 for an empty status, Finished, Lapped or +n laps; else 1."""
    s = F.trim(F.coalesce(status, F.lit("")))
    fine = (s == "") | s.isin("Finished", "Lapped") | s.startswith("+")
    return F.when(fine, 0).otherwise(1)


def duration_seconds(text: Column) -> Column:
    """``m:ss.sss`` or plain seconds to seconds; anything else is null."""
    t = F.trim(text)
    parts = F.split(t, ":")
    minutes, seconds = parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 2, minutes * 60 + seconds).when(F.size(parts) == 1, t.try_cast("double"))


def plain_letters(text: Column) -> Column:
    """Lower case without accents; other non-ASCII characters are dropped."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, BASE), r"[^\x00-\x7f]", "")


def venue_key(name: Column) -> Column:
    """``São Paulo Grand Prix`` to ``sao_paulo_gp``."""
    t = F.regexp_replace(F.trim(plain_letters(name)), "[- ]", "_")
    return F.replace(t, F.lit("grand_prix"), F.lit("gp"))


def team_key(name: Column) -> Column:
    """Lower case, runs of other characters to one underscore, none at the ends."""
    t = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")
    return F.regexp_replace(t, "^_+|_+$", "")


def person_key(name: Column) -> Column:
    """Plain words; hyphens and dots separate; jr and sr are dropped."""
    t = F.regexp_replace(plain_letters(name), r"[-.\s]+", " ")
    words = F.filter(F.split(F.trim(t), " "), lambda w: ~w.isin("jr", "sr"))
    return F.array_join(words, " ")


def first_name_key(name: Column) -> Column:
    """Letters a-z only; a few letters are spelled out."""
    t = F.lower(F.trim(name))
    for letter, spelled in (("ł", "l"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o")):
        t = F.replace(t, F.lit(letter), F.lit(spelled))
    return F.regexp_replace(plain_letters(t), "[^a-z]", "")


def surname(text: Column) -> Column:
    """Letters, spaces, apostrophes and hyphens; single spaces; at most 30 characters."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\s'\-]", "")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, 30)


def canonical_venue(event: Column, location: Column, year: Column) -> Column:
    """Location first, then the event name (one event changes venue in a given year), else the key."""
    loc, key = venue_key(location), F.coalesce(venue_key(event), F.lit(""))
    moved = (key == "spanish_gp") & (year >= fv.SPANISH_MOVE_YEAR)
    return F.coalesce(
        mapped(loc, fv.VENUE_BY_LOCATION),
        F.when(moved, fv.SPANISH_MOVE_VENUE),
        mapped(key, fv.VENUE_BY_EVENT),
        mapped(key, fv.VENUE_BY_LOCATION),
        F.when(key != "", key),
        F.lit("unknown"),
    )


def canonical_team(name: Column) -> Column:
    """Today's name of the team's lineage; unknown names are trimmed; null is Unknown."""
    aliases = {a: team for team, names in fv.TEAM_LINEAGE.items() for a in names}
    return F.when(name.isNull(), "Unknown").otherwise(F.coalesce(mapped(team_key(name), aliases), F.trim(name)))


def knockout_stage(position: Column, n: Column) -> Column:
    """3 for the first ten, 2 for the better half of the rest, else 1."""
    return F.when(position <= 10, 3).when(position <= 10 + F.floor((n - 10) / 2), 2).otherwise(1)


def claim_probability(p: Column, negate: Column) -> Column:
    return F.when(negate, 1 - p).otherwise(p)


def accepted(p: Column, limit: float = 0.35) -> Column:
    return p <= limit


def ticket_id(year: Column, round_: Column, seq: Column, suffix: Column) -> Column:
    """``1996-03-007-ab12``"""
    return F.concat(
        year.cast("string"), F.lit("-"), F.lpad(round_.cast("string"), 2, "0"), F.lit("-"),
        F.lpad(seq.cast("string"), 3, "0"), F.lit("-"), suffix,
    )


def claim_text(bettor: Column, entrant: Column, event: Column, negate: Column) -> Column:
    verb = F.when(negate, F.lit("will not")).otherwise(F.lit("will"))
    goal = F.when(event == "win", "win").otherwise("reach the podium")
    return F.concat_ws(" ", bettor.cast("string"), F.lit("says"), entrant.cast("string"), verb, goal)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, rounded to the nearest."""
    us = F.timestamp_diff("MICROSECOND", start, end)
    return F.round(us / 60e6, 0).cast("bigint")


def cron_delay_minutes(now: Column, minute: int, hour: int | None = None) -> Column:
    """Minutes since the latest slot of a ``minute hour`` schedule (every hour without an hour)."""
    past = F.minute(now) - minute + (0 if hour is None else (F.hour(now) - hour) * 60)
    late = past + F.second(now).cast("double") / 60.0
    cycle = 60.0 if hour is None else 1440.0
    return F.when(late < 0, late + cycle).otherwise(late)


def contest_id(year: Column, round_: Column) -> Column:
    return year * 100 + round_


def before(year: Column, round_: Column, y: int, r: int) -> Column:
    """Strictly earlier than contest (y, r)."""
    return F.struct(year.cast("int").alias("y"), round_.cast("int").alias("r")) < F.struct(F.lit(y).alias("y"), F.lit(r).alias("r"))


def code_of(name: Column, codes: Mapping[str, str]) -> Column:
    """Code of the full name, else of the last word."""
    n = person_key(name)
    return F.coalesce(mapped(n, codes), mapped(F.try_element_at(F.split(n, " "), F.lit(-1)), codes))
