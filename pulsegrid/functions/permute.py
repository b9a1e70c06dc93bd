"""Keyed bijections of a range of numbers, as expressions.

A draw or a shuffle of n things usually sorts them by a random key. A bijection
of [0, n) gives place k of a shuffle from k alone: nothing is listed or sorted,
every key gives another order, and a recomputed task gets the same one. Only a
range of up to ``SMALL`` numbers is sorted by hash, where all n! orders must be
equally likely.

The range is laid out as a grid of two numbers, which are shifted in turn by a
hash of the other one (a Feistel network over residues). Each shift can be
undone, so the whole is a bijection of the grid. Where the grid has more places
than the range, those outside are led on through the bijection until they come
back in, which keeps it one of the range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shifts of a network; each side is moved by half of them.
SHIFTS = 6
#: Ranges up to here are sorted.
SMALL = 64
#: Steps back into the range. With the grid used here less than one place in sqrt(n) is outside, and never more than sqrt(n) + 1.
STEPS = 64


def _hashed(tag: Column, turn: int, value: Column, modulus: Column) -> Column:
    """52 bits of md5(tag:turn:value), modulo ``modulus``."""
    digest = F.md5(F.concat(tag, F.lit(f":{turn}:"), value.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint"), modulus)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def _grid(tag: Column, rows: Column, columns: Column, row: Column, column: Column) -> Column:
    """struct(row, column): where the network of ``tag`` takes a place of a grid of ``rows`` times ``columns``."""

    def shift(turn: int, at: Column) -> Column:
        if turn == SHIFTS:
            return at
        if turn % 2:
            moved = F.pmod(at["column"] + _hashed(tag, turn, at["row"], columns), columns)
            then = F.struct(at["row"].alias("row"), moved.alias("column"))
        else:
            moved = F.pmod(at["row"] + _hashed(tag, turn, at["column"], rows), rows)
            then = F.struct(moved.alias("row"), at["column"].alias("column"))
        return _let(then, lambda nxt: shift(turn + 1, nxt))

    start = F.struct(row.cast("bigint").alias("row"), column.cast("bigint").alias("column"))
    return _let(start, lambda at: shift(0, at))


def permute(tag: Column, n: Column, place: Column) -> Column:
    """Where the bijection of ``tag`` on [0, ``n``) takes ``place``; ``n`` is below 2**50."""
    n = n.cast("bigint")
    rows = F.ceil(F.sqrt(n))
    columns = F.ceil(n / rows)

    def once(at: Column) -> Column:
        moved = _grid(tag, rows, columns, F.floor(at / columns), F.pmod(at, columns))
        return _let(moved, lambda x: x["row"] * columns + x["column"])

    def back(first: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(STEPS))
        found = F.aggregate(steps, first, lambda at, _: F.when(at < n, at).otherwise(once(at)))
        return _let(found, lambda at: F.when(at < n, at).otherwise(F.raise_error(F.lit("no way back into the range")).cast("bigint")))

    by_hash = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.struct(F.md5(F.concat(tag, F.lit(":"), i.cast("string")).cast("binary")).alias("h"), i.alias("i")))
    sorted_place = F.get(F.array_sort(by_hash), place.cast("int"))["i"]
    large = _let(once(place.cast("bigint")), lambda first: F.when(first < n, first).otherwise(back(first)))
    return F.when(n <= SMALL, sorted_place).otherwise(large)


def sql_permute(tag: str, n: str, rows: str, columns: str, place: str) -> str:
    """:func:`permute` as text for the checking SQL; ``rows`` and ``columns`` name the sides of the grid."""

    def once(at: str) -> str:
        row, column = f"({at} // {columns})", f"({at} % {columns})"
        for turn in range(SHIFTS):
            value, modulus = (row, columns) if turn % 2 else (column, rows)
            drawn = f"CAST(concat('0x', substr(md5(concat({tag}, ':{turn}:', CAST({value} AS VARCHAR))), 1, 13)) AS BIGINT) % {modulus}"
            if turn % 2:
                column = f"(({column} + {drawn}) % {columns})"
            else:
                row = f"(({row} + {drawn}) % {rows})"
        return f"({row} * {columns} + {column})"

    small = f"list_sort([{{'h': md5(concat({tag}, ':', CAST(i AS VARCHAR))), 'i': i}} for i in range({n})])[{place} + 1].i"
    large = f"list_reduce([{once(place)}] || range({STEPS}), lambda acc, _: CASE WHEN acc < {n} THEN acc ELSE {once("acc")} END)"
    return f"CASE WHEN {n} <= {SMALL} THEN {small} ELSE {large} END"
