"""Plan inspection for tests and reviews: walk the physical plan of a DataFrame.

Used to assert plan properties (no cartesian products, windows only over aggregated
input, filters reaching the scan) rather than only results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Node:
    name: str
    text: str
    children: list["Node"] = field(default_factory=list)
    meta: dict = field(default_factory=dict)  # untruncated scan metadata (PushedFilters, ReadSchema, ...)
    reused: list["Node"] = field(default_factory=list)  # the exchange whose output is read again

    def walk(self):
        """The nodes that run; what a reused exchange stands for runs once, elsewhere."""
        yield self
        for c in self.children:
            yield from c.walk()


def _seq(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def _convert(jnode) -> Node:
    name = jnode.nodeName()
    if "QueryStage" in name:
        kids = [jnode.plan()]
    elif name == "AdaptiveSparkPlan":
        kids = [jnode.executedPlan()]
    elif name == "ReusedExchange":
        kids = []
    else:
        kids = _seq(jnode.children())
    reused = [jnode.child()] if name == "ReusedExchange" else []
    meta = {}
    if name.startswith("Scan"):
        try:
            m = jnode.metadata()
            for key in ("PushedFilters", "ReadSchema", "Location", "PartitionFilters"):
                opt = m.get(key)
                if opt.isDefined():
                    meta[key] = opt.get()
        except Exception:  # not a file scan
            pass
    elif name == "Window":
        meta["partitionSpec"] = [e.sql() for e in _seq(jnode.partitionSpec())]
        meta["orderSpec"] = [e.sql() for e in _seq(jnode.orderSpec())]
    return Node(name, jnode.simpleString(400), [_convert(k) for k in kids], meta, [_convert(k) for k in reused])


def physical_plan(df: DataFrame) -> Node:
    """The physical plan tree (the final adaptive plan once the DataFrame has run)."""
    return _convert(df._jdf.queryExecution().executedPlan())


def node_names(df: DataFrame) -> list[str]:
    return [n.name for n in physical_plan(df).walk()]


def scans(df: DataFrame) -> list[str]:
    """Descriptions of the file scans (with pushed filters and read schema)."""
    return [
        f"{n.text} {n.meta.get('PushedFilters', '')}" for n in physical_plan(df).walk() if n.name.startswith("Scan")
    ]


def first_below(node: Node, names: tuple[str, ...]) -> str | None:
    """Name of the first node under ``node`` (depth first, through reused exchanges) whose name
    starts with one of ``names``."""
    for child in node.children + node.reused:
        found = child.name if child.name.startswith(names) else first_below(child, names)
        if found:
            return found
    return None
