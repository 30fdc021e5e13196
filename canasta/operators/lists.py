"""Shopping lists: changes by compare-and-set, and the merge of an anonymous list into an owner's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold

#: Items of a list at most.
CAPACITY = 50


def start() -> dict:
    """A list that is not there yet: revision 0, no items, and devices that know of none."""
    return {"revision": 0, "items": {}, "known": {}}


def change(state: dict, removes: bool, item: str, amount: int, expected: int) -> tuple[dict, str]:
    """The list after a change that expects a revision, and what became of the change."""
    revision, items = state["revision"], state["items"]
    if expected != revision:
        return state, "conflict"
    if removes and item not in items:
        return state, "unchanged"
    if not removes and item not in items and len(items) >= CAPACITY:
        return state, "rejected"
    now = {k: v for k, v in items.items() if k != item} if removes else items | {item: amount}
    return state | {"revision": revision + 1, "items": now}, "removed" if removes else "saved"


def mutate(operations: DataFrame, order: list[str]) -> DataFrame:
    """order columns, owner, expected, status, revision and items (how many) after each operation.

    operations: owner, device, removes, item, amount and the order columns. A device expects the revision that it
    saw last: that of its own last change, or the one that a conflict told it. Of operations that the order columns
    leave tied, removals come first, as they make room, then the device, item and amount decide; those alike in all
    of these are the same operation, so that the result never hangs on how rows lie in files or shuffles.
    """

    def step(state: dict, row: dict) -> tuple[dict, dict]:
        expected = state["known"].get(row["device"], 0)
        state, status = change(state, row["removes"], row["item"], row["amount"], expected)
        state = state | {"known": state["known"] | {row["device"]: state["revision"]}}
        return state, {"owner": row["owner"], **{c: row[c] for c in order}, "expected": expected, "status": status, "revision": state["revision"], "items": len(state["items"])}

    kinds = ", ".join(f"`{c}` {operations.schema[c].dataType.simpleString()}" for c in order)
    total = [*order, F.desc("removes"), "device", "item", "amount"]
    return ordered_fold(operations, ["owner"], total, start, step, f"owner long, {kinds}, expected long, status string, revision long, items long")


def import_plan(remote: DataFrame, anonymous: DataFrame) -> DataFrame:
    """owner, item, kept (remote or anonymous) and outcome of each item of both lists.

    Both have owner, item and updated; the anonymous one an order besides. An item of both is taken from the newer
    side, the remote one at a tie (``unchanged`` or ``updated``); new items join in order while the list has room
    (``added``), later ones are ``rejected`` and stay with the anonymous list.
    """
    a = remote.select("owner", "item", F.col("updated").alias("remote_at"))
    b = anonymous.select("owner", "item", F.col("updated").alias("anonymous_at"), "order")
    both = a.join(b, ["owner", "item"], "full")
    held = F.count("remote_at").over(Window.partitionBy("owner"))
    is_new = F.col("remote_at").isNull()
    place = F.count_if(is_new).over(Window.partitionBy("owner").orderBy(F.col("order").asc_nulls_first(), "item"))
    room = held + place <= CAPACITY
    outcome = F.when(F.col("anonymous_at").isNull(), "remote").when(is_new, F.when(room, "added").otherwise("rejected")).when(F.col("remote_at") >= F.col("anonymous_at"), "unchanged").otherwise("updated")
    return both.select("owner", "item", outcome.alias("outcome"))
