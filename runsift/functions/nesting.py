"""Which items enclose which: small helpers that need a stack.

They work on the items of one row, and are Arrow-batched because no
built-in expression keeps a stack of unbounded depth. The functions are built
inside factories so that they travel to the executors by value.
"""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

PLACES = ArrayType(ArrayType(IntegerType()))


def _by_level():
    def one(levels):
        stack, found = [], []
        for place, level in enumerate(levels):
            while level is not None and stack and stack[-1][0] >= level:
                stack.pop()
            found.append([at for _, at in stack])
            if level is not None:
                stack.append((level, place))
        return found

    def enclosing(levels: pa.Array) -> pa.Array:
        rows = [None if row is None else one(row) for row in levels.to_pylist()]
        return pa.array(rows, type=pa.list_(pa.list_(pa.int32())))

    return F.arrow_udf(enclosing, PLACES)


def enclosing_by_level(levels):
    """Items enclose the deeper ones that follow; an item without a level only looks."""
    return _by_level()(levels)


SUB_CASES = "array<struct<case: string, name: string, failed: boolean>>"


def _sub_cases():
    def one(kinds, closes, opens, names, results):
        stack, found = [], []
        for kind, closed, opened, name, result in zip(kinds, closes, opens, names, results):
            del stack[max(0, len(stack) - (closed or 0)) :]
            entry = {"case": None, "name": "None" if name is None else name, "failed": False}
            if kind == "SubCase" and not closed:
                entry["case"] = next((e["name"] for k, e in stack if k == "TestCase"), None)
                found.append(entry)
            if kind == "Expression" and not closed and result != "true":
                for _, outer in stack:
                    outer["failed"] = True
            if opened:
                stack.append((kind, entry))
        return [e for e in found if e["case"] is not None]

    def walk(kinds: pa.Array, closes: pa.Array, opens: pa.Array, names: pa.Array, results: pa.Array) -> pa.Array:
        rows = [None if row[0] is None else one(*row) for row in zip(*(a.to_pylist() for a in (kinds, closes, opens, names, results)))]
        return pa.array(rows, type=pa.list_(pa.struct([("case", pa.string()), ("name", pa.string()), ("failed", pa.bool_())])))

    return F.arrow_udf(walk, SUB_CASES)


def sub_cases(kinds, closes, opens, names, results):
    """Sub-cases of a report's tags in order, with the test case that they stand in and whether anything within failed."""
    return _sub_cases()(kinds, closes, opens, names, results)
