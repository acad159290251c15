"""JSON containment (FLT12, FLT13): whether a document holds a filter document.

An object holds another if it has its keys with values that hold the other's; an array holds another if each of the
other's elements is held by one of its own; other values have to be equal, of the same type (1 and 1.0 are). At the top an array
holds a single value among its elements, too. A row whose JSON is broken holds nothing.
"""

from __future__ import annotations

import json
from decimal import Decimal
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def parsed(text: Column) -> Column:
    """JSON as a variant, null where it is broken."""
    return F.try_parse_json(text)


def _path(key: str) -> str:
    quote = "'" if "'" not in key else '"'
    if quote in key:
        raise ValueError(f"a key with both kinds of quotes can't be asked for: {key}")
    return f"$[{quote}{key}{quote}]"


def _any_holds(elements: Column, wanted) -> Column:
    return F.exists(elements, lambda e: F.coalesce(_holds(e, wanted), F.lit(False)))


def _holds(v: Column, wanted) -> Column:
    kind, as_ = F.schema_of_variant(v), lambda t: F.try_variant_get(v, "$", t)
    if isinstance(wanted, dict):
        return reduce(and_, [_holds(F.try_variant_get(v, _path(k), "variant"), x) for k, x in wanted.items()], kind.startswith("OBJECT"))
    if isinstance(wanted, list):
        own = as_("array<variant>")
        return reduce(and_, [_any_holds(own, x) for x in wanted], kind.startswith("ARRAY"))
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (as_("boolean") == wanted)
    if isinstance(wanted, str):
        return (kind == "STRING") & (as_("string") == wanted)
    whole = isinstance(wanted, int)
    return kind.rlike(NUMBER) & (as_("decimal(38,10)" if whole else "double") == F.lit(Decimal(wanted) if whole else wanted))


def holds(v: Column, wanted) -> Column:
    """Whether a variant holds `wanted` (what json.loads gives); False for null."""
    found = F.coalesce(_holds(v, wanted), F.lit(False))
    if isinstance(wanted, (dict, list)):
        return found
    return found | F.coalesce(_any_holds(F.try_variant_get(v, "$", "array<variant>"), wanted), F.lit(False))


def value_holds(own, wanted) -> bool:
    """The same for two parsed values."""
    if isinstance(wanted, dict):
        return isinstance(own, dict) and all(k in own and value_holds(own[k], x) for k, x in wanted.items())
    if isinstance(wanted, list):
        return isinstance(own, list) and all(any(value_holds(e, x) for e in own) for x in wanted)
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return own == wanted and (number(own) and number(wanted) or type(own) is type(wanted))


def _loads(text: str | None):
    try:
        return (json.loads(text),) if text is not None else None
    except ValueError:
        return None


@F.arrow_udf(BooleanType())
def json_holds(document: pa.Array, wanted: pa.Array) -> pa.Array:
    """For SQL, where the filter is a value: holds() of two JSON texts; a filter that is null or broken is held by none."""
    filters = {x: _loads(x) for x in set(wanted.to_pylist())}
    out = []
    for d, x in zip(document.to_pylist(), wanted.to_pylist(), strict=True):
        own, asked = _loads(d), filters[x]
        found = own is not None and asked is not None and value_holds(own[0], asked[0])
        if own is not None and asked is not None and not found and not isinstance(asked[0], (dict, list)) and isinstance(own[0], list):
            found = any(value_holds(e, asked[0]) for e in own[0])
        out.append(found)
    return pa.array(out, pa.bool_())


def register(spark: SparkSession) -> None:
    spark.udf.register("json_holds", json_holds)
