"""An observable store. Patches merge into its state field by field; every patch tells what the state is then.

A patch is a map: a field it lacks stays as it is, a field with a null becomes
null. Patches of one store merge right over left, which is associative: a store
with a large part of all patches is cut into ranges, each range's patches merge
into one, those of the earlier ranges are what a range starts from, and all
ranges are walked at once.

Defined cases: a null patch changes nothing but is told; a null key is one
store; patches of one time are taken in the order of `seq`, null times first;
an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField

from siltstone.operators.ranges import RANGE_ROWS, Fold, Ranges

#: The store's fields before any patch.
INITIAL = {"stagedPayload": None, "inputPayload": None, "processingResult": None, "processingState": "idle", "validationError": None}
PATCH = MapType(StringType(), StringType())


def merged(state: dict, patch) -> dict:
    """The state with a patch over it, in place; patches come as pairs."""
    state.update(patch or ())
    return state


def _merge(first: bytes, then: bytes) -> bytes:
    return json.dumps(merged(json.loads(first), json.loads(then))).encode()


def store_states(patches: DataFrame, initial: dict | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(key, at, seq, state) for every (key, at, seq, patch): the state after that patch, fields in the order of their names."""
    start, order = dict(INITIAL if initial is None else initial), ["at", "seq"]
    rows = patches.select("key", "at", "seq", F.col("patch").cast(PATCH).alias("patch"))
    ranges = Ranges(rows, range_rows)
    before = ranges.prefixes(Fold(order, ["patch"], [], lambda seed: {}, merged, lambda s: json.dumps(s).encode()), _merge)
    told = Fold(order, ["patch"], ["at", "seq"], lambda seed: merged(dict(start), json.loads(seed)) if seed else dict(start), lambda s, p: (sorted(merged(s, p).items()),))
    return ranges.walk(told, [StructField("state", PATCH)], before)
