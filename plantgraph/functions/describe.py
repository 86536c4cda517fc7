"""One-line renderings of nodes and edges, as columns: only what is declared is said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: The word under which a node's sub-kind is shown
WORDS = {"cooling_plant": "plant", "chiller": "chiller", "pump": "pump", "cooling_loop": "loop", "cdu": "cdu", "crah": "placement", "crac": "placement", "manifold": "manifold", "branch": "branch", "thermal_zone": "class", "cooling_sink": "sink", "cooling_source": "source"}


def node() -> Column:
    word = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])[F.col("kind")]

    def part(key: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value))

    name = F.when(F.coalesce("display_name", F.lit("")) != "", text.escaped(F.col("display_name")))
    consumer = F.when(F.col("kind") == "cooling_sink", F.concat_ws(":", "consumer.kind", "consumer.identity"))
    return F.concat_ws(" ", F.lit("node"), "node_id", F.concat(F.lit("kind="), "kind"), F.concat(word, F.lit("="), "subkind"), part("role", F.col("pump_role")), part("medium", F.col("medium")), part("consumer", consumer), part("design-supply", text.celsius(F.col("design_supply_mc"))), part("max-supply", text.celsius(F.col("max_supply_mc"))), part("name", name))


def edge() -> Column:
    return F.concat_ws(" ", F.lit("edge"), "edge_id", "kind", F.concat_ws(".", "from_node", "from_port"), F.lit("->"), F.concat_ws(".", "to_node", "to_port"))
