"""Column expressions for quantities, times, codes, states, names and paths.

All but rare encodings of bytes are built-in functions; what cannot be parsed gives null.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes by unit.
MEMORY_UNITS = {"B": 1, "kB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "PB": 10**15, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40, "PiB": 2**50}
#: Nanoseconds by unit, under all accepted names.
NANOSECONDS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}
DURATION_NAMES = {
    "ns": ["ns", "nanosec", "nanosecond", "nanoseconds"], "us": ["us", "microsec", "microsecond", "microseconds"], "ms": ["ms", "millisec", "millisecond", "milliseconds"],
    "s": ["s", "sec", "second", "seconds"], "m": ["m", "min", "minute", "minutes"], "h": ["h", "hr", "hour", "hours"], "d": ["d", "day", "days"], "w": ["w", "week", "weeks"],
}
SECOND = 10**9
#: Pseudo-signals, for tasks that ended for a reason other than a signal.
PSEUDO_SIGNALS = {
    120: "Remote site reports no information about the job",
    121: "Job canceled by user",
    122: "Job killed by batch system or sysadmin",
    123: "Data staging failure",
    124: "Unspecified remote error, e.g., execution node crashed or batch system misconfigured",
    125: "Submission to batch system failed.",
}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group of the match; null where it is empty or nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once. Its code stands apart, so that the methods generated around it stay small enough to be compiled."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_memory(text: Column) -> Column:
    """Bytes of an amount with a unit, such as 5MB or 2 GiB; whole amounts stay exact."""
    amount, unit = _part(text, r"^\s*(\d+(?:\.\d+)?)\s*([kKMGTP]?i?B)\s*$", 1), _part(text, r"^\s*(\d+(?:\.\d+)?)\s*([kKMGTP]?i?B)\s*$", 2)
    factor = _lookup(MEMORY_UNITS, unit)
    return F.coalesce(amount.try_cast("long") * factor, F.floor(amount.try_cast("double") * factor).cast("long"))


def parse_suffixed_memory(text: Column, suffixes: dict[str, int], bare: int = 1) -> Column:
    """Bytes of an amount with a suffix of letters, as accounting files have it; rounded. `bare` is the factor without a suffix."""
    pattern = rf"^ *([0-9]+(?:\.[0-9]+)?) *({'|'.join(suffixes)})? *\z"  # two extractions and a look-up, each of them evaluated once
    factor = _lookup({"": bare, **suffixes}, F.regexp_extract(text, pattern, 2))
    return F.round(F.regexp_extract(text, pattern, 1).try_cast("double") * factor).cast("long")


#: Factors of the batch systems' memory suffixes.
SLURM_MEMORY = {"K": 1000, "M": 10**6, "G": 10**9, "T": 10**12}
SGE_MEMORY = {"K": 2**10, "M": 2**20, "G": 2**30, "T": 2**40, "k": 10**3, "m": 10**6, "g": 10**9}
PBS_MEMORY = {"b": 1, "kb": 1000, "mb": 10**6, "gb": 10**9}
LSF_MEMORY = {"K": 1000, "M": 10**6, "G": 10**9, "T": 10**12}


def parse_duration(text: Column) -> Column:
    """Nanoseconds: HH:MM:SS, DD:HH:MM:SS, words such as `1d 4h 9m`, or an amount with a unit. XX:YY is ambiguous: null."""
    n = lambda p, g: _part(text, p, g).try_cast("long")
    three, four = r"^\s*(\d+):(\d+):(\d+)\s*$", r"^\s*(\d+):(\d+):(\d+):(\d+)\s*$"
    clock = (n(three, 1) * 3600 + n(three, 2) * 60 + n(three, 3)) * SECOND
    days = (n(four, 1) * 86400 + n(four, 2) * 3600 + n(four, 3) * 60 + n(four, 4)) * SECOND
    names = {name: NANOSECONDS[unit] for unit, all_names in DURATION_NAMES.items() for name in all_names}
    word = r"(\d+)\s*([A-Za-z]+)"
    items = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    value = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + F.regexp_extract(x, word, 1).cast("long") * _lookup(names, F.regexp_extract(x, word, 2)))
    words = F.when(text.rlike(rf"^\s*(?:{word}\s*)+$"), value)
    one = r"^\s*(\d+\.\d+)\s*([A-Za-z]+)\s*$"
    fraction = F.floor(_part(text, one, 1).try_cast("double") * _lookup(names, F.regexp_extract(text, one, 2))).cast("long")
    return F.coalesce(clock, days, words, fraction)


def parse_elapsed(text: Column) -> Column:
    """Nanoseconds of [DD-][[HH:]MM:]SS[.fff][s], where two fields are minutes and seconds."""
    pattern = r"^\s*(?:\d+-)?(?:(?:\d+:)?\d+:)?\d+(?:\.\d{1,9})?s?\s*$"
    # one expression tells the form; the fields, of which some may be missing, are then cut out without further ones
    plain = F.rtrim(F.trim(F.translate(text, "\t\n\r\f\x0b", "     ")), F.lit("s"))
    number = lambda x: F.concat(F.lit("0"), x).try_cast("long")  # noqa: E731  # one that is too large is null

    def value(plain: Column) -> Column:
        clock = F.concat(F.lit("0:0:"), F.substring_index(plain, "-", -1))  # a missing field is 0
        field = lambda k: number(F.substring_index(F.substring_index(clock, ":", -k), ":", 1))
        second = number(F.substring_index(F.substring_index(clock, ":", -1), ".", 1))
        days = F.when(F.contains(plain, F.lit("-")), number(F.substring_index(plain, "-", 1))).otherwise(0)
        fraction = F.when(F.contains(plain, F.lit(".")), number(F.rpad(F.substring_index(plain, ".", -1), 9, "0"))).otherwise(0)
        return (days * 86400 + field(3) * 3600 + field(2) * 60 + second) * SECOND + fraction

    return F.when(text.rlike(pattern), _bound(plain, value))


def quantity_text(amount: Column, units: dict[str, int]) -> Column:
    """The amount in the largest unit that gives at least 1, whole units only where exact, else with up to 3 decimals.

    Decimals are rounded as binary floating point has them, as SQL engines do: thousandths to the nearest whole number, halves away from 0.
    """
    ordered = sorted(units.items(), key=lambda x: -x[1])
    show = lambda unit, size: F.concat((F.round(amount / size * 1000, 0) / 1000).cast("string"), F.lit(unit))
    last, size = ordered[-1]
    return reduce(lambda rest, x: F.when(amount >= x[1], show(*x)).otherwise(rest), list(reversed(ordered))[1:], show(last, size))


def quantity_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def parse_timestamp_any(text: Column, formats: list[str]) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def infer_year(month: Column, day: Column, hour: Column, minute: Column, reference: Column) -> Column:
    """A time without a year: the reference's year if the month is not after the reference's month, else the year before."""
    year = F.year(reference) - F.when(month <= F.month(reference), 0).otherwise(1)
    return F.try_make_timestamp_ntz(year, month, day, hour, minute, F.lit(0.0)) if hasattr(F, "try_make_timestamp_ntz") else F.make_timestamp_ntz(year, month, day, hour, minute, F.lit(0.0))


def encode_returncode(exitcode: Column, signal: Column) -> Column:
    """exitcode (8 bits) above signal (7 bits); null if both are null, exit code 255 where only a signal is known."""
    code = F.coalesce(exitcode, F.when(signal.isNotNull(), -1))
    return F.shiftleft(code.bitwiseAND(F.lit(0xFF)), 8).bitwiseOR(F.coalesce(signal, F.lit(0)).bitwiseAND(F.lit(0x7F)))


def decode_exitcode(returncode: Column) -> Column:
    return F.shiftright(returncode, 8).bitwiseAND(F.lit(0xFF))


def decode_signal(returncode: Column) -> Column:
    return returncode.bitwiseAND(F.lit(0x7F))


def shell_exit(rc: Column) -> tuple[Column, Column]:
    """(signal, exitcode) of a shell's status, of which the low 8 bits count: above 128 a signal killed the command."""
    low = rc.bitwiseAND(F.lit(0xFF))
    return F.when(low > 128, low - 128).otherwise(0), F.when(low > 128, -1).otherwise(low)


#: State codes of the batch systems, first match decides; patterns on the whole code.
BATCH_STATES = {
    "sge": [("s|S|T|h.*", "STOPPED"), (".*qw.*", "SUBMITTED"), (".*[rRt].*", "RUNNING"), ("E", "TERMINATING")],
    "slurm": [("PENDING|CONFIGURING", "SUBMITTED"), ("RUNNING|COMPLETING", "RUNNING"), ("SUSPENDED", "STOPPED"), ("(?:COMPLETED|CANCELLED|FAILED|NODE_FAIL|PREEMPTED|TIMEOUT)(?: .*)?", "TERMINATING")],
    "pbs": [("Q|W", "SUBMITTED"), ("R", "RUNNING"), ("S|H|T|.*qh.*", "STOPPED"), ("C|E|F", "TERMINATING")],
    "lsf": [("PEND", "SUBMITTED"), ("RUN", "RUNNING"), ("PSUSP|USUSP|SSUSP", "STOPPED"), ("DONE|EXIT|ZOMBI", "TERMINATING")],
    "ps": [("[RSDYIWZ].*", "RUNNING"), ("[TtX].*", "STOPPED")],
}


def map_batch_state(system: str, code: Column) -> Column:
    """The task state of a batch system's code; UNKNOWN for other codes."""
    out = F.lit("UNKNOWN")
    for pattern, state in reversed(BATCH_STATES[system]):
        out = F.when(code.rlike(f"^(?:{pattern})$"), state).otherwise(out)
    return out


def signal_description(signal: Column) -> Column:
    """The text of a pseudo-signal; null for others."""
    return _lookup(PSEUDO_SIGNALS, signal)


def parse_boolean(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "yes", "on", "1"), F.lit(False))


def parse_percent(text: Column) -> Column:
    return F.rtrim(F.trim(text), F.lit("%")).try_cast("double")


def parse_power_notation(text: Column) -> Column:
    """`5x10min6` is 5e-6; otherwise a plain number."""
    pattern = r"^\s*([0-9.]+)x10(min)?(\d+)\s*$"
    power = F.regexp_extract(text, pattern, 3).try_cast("int") * F.when(F.regexp_extract(text, pattern, 2) == "min", -1).otherwise(1)
    return F.coalesce(_part(text, pattern, 1).try_cast("double") * F.pow(F.lit(10.0), power), text.try_cast("double"))


def split_run_name(run: Column) -> Column:
    """`a=1_b=2` as a map; the key beta becomes beta_disc."""
    return F.transform_keys(F.str_to_map(run, F.lit("_"), F.lit("=")), lambda k, _: F.when(k == "beta", "beta_disc").otherwise(k))


def normalise_name(text: Column) -> Column:
    """Words with a lower first letter, dots removed, - as _, joined by _."""
    words = F.split(F.trim(text), r"\s+")
    lower = F.transform(words, lambda w: F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, 2, 10**6)))
    return F.replace(F.replace(F.array_join(lower, "_"), F.lit("."), F.lit("")), F.lit("-"), F.lit("_"))


def format_value(text: Column) -> Column:
    """Whole numbers as they are, other numbers with 15 decimals, other text as it is."""
    number = r"^[+-]?\d*\.\d+(?:[eE][+-]?\d+)?$"
    return F.when(text.rlike(number), F.format_string("%.15f", text.try_cast("double"))).otherwise(text)


def url_parts(url: Column) -> Column:
    """scheme (file if absent), host, path, query and fragment; path and scheme are always there."""
    has = url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    g = lambda k: F.regexp_extract(url, pattern, k)
    return F.struct(F.when(has, F.lower(g(1))).otherwise("file").alias("scheme"), g(2).alias("host"), g(3).alias("path"), g(4).alias("query"), g(5).alias("fragment"))


def url_adjoin(url: Column, relative: str) -> Column:
    """The path extended by one part; query and fragment stay."""
    pattern = r"^([^?#]*?)/*((?:\?[^#]*)?(?:#.*)?)$"
    return F.concat(F.regexp_extract(url, pattern, 1), F.lit("/" + relative.lstrip("/")), F.regexp_extract(url, pattern, 2))


def io_map(paths: Column) -> Column:
    """Paths to their last parts; a path that occurs twice counts once."""
    once = F.array_distinct(paths)
    return F.map_from_arrays(once, F.transform(once, lambda p: F.regexp_extract(p, "[^/]*$", 0)))


def decode_bytes(data: Column, encodings: Sequence[str] = ("utf-8", "latin-1")) -> Column:
    """The text in the first of the encodings that decodes all bytes; null where none does.

    UTF-8 and Latin-1 are decoded in the JVM. Others are tried by strict decoders in Arrow batches, which get only what the encodings before them
    could not decode. Unknown names of encodings raise at once.
    """
    names = [codecs.lookup(e).name for e in encodings]
    found: Column | None = None
    while names:
        left = data if found is None else F.when(found.isNull(), data)
        if names[0] == "utf-8":
            made, names = F.try_validate_utf8(left.cast("string")), names[1:]
        elif names[0] == "iso8859-1":
            made, names = F.decode(left, "ISO-8859-1"), []  # it decodes everything
        else:
            n = next((k for k, e in enumerate(names) if e in ("utf-8", "iso8859-1")), len(names))
            made, names = _strictly(names[:n])(left), names[n:]
        found = made if found is None else F.coalesce(found, made)
    return F.lit(None).cast("string") if found is None else found


def _strictly(names: list[str]) -> Callable[[Column], Column]:
    """The first of some encodings that decodes, value by value in Arrow batches."""

    def first(value: bytes | None) -> str | None:
        for name in names if value is not None else ():
            try:
                return value.decode(name)
            except UnicodeDecodeError:
                pass
        return None

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return pd.Series([first(v) for v in values], dtype=object)

    return decoded


def substitute_template(template: Column, values: Column) -> Column:
    """${key} replaced from a map, once: what a value brings in is not replaced again. Unknown keys stay."""
    part = r"(?s)\$\{[^}]*\}|(?:(?!\$\{[^}]*\}).)+"
    piece = lambda p: F.coalesce(F.when(F.startswith(p, F.lit("${")), F.try_element_at(values, F.substring(p, F.lit(3), F.length(p) - 3))), p)
    return F.array_join(F.transform(F.regexp_extract_all(template, F.lit(part), F.lit(0)), piece), "")
