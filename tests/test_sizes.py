"""What an image takes, summed where the rows are, is what the image has."""

import duckdb

from plantgraph.plans import structure_queries  # noqa: F401  registers its queries
from plantgraph.plans.graph_queries import ORACLES, QUERIES
from plantgraph.sources import canonical, generator


def test_sizes_of_the_workload(spark, tmp_path):
    t = generator.workload(spark, 40)
    image = canonical.encode(canonical.order(canonical.rows_of(t)), t.header)
    parts = {(r.part, r.kind): (r["rows"], r.bytes) for r in canonical.sizes(generator.workload(spark, 40)).collect()}
    assert parts["image", ""] == (124 + 484, len(image)) == (608, 27658)
    assert parts["file", ""] == (608, len(canonical.frame(image)))
    assert sum(n for (part, _), (n, _) in parts.items() if part == "node") == 124


def test_workload_query_has_nodes_edges_and_image(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{sf}/supplier.parquet'")
    got = sorted(tuple(r) for r in QUERIES["s8_workload"](spark, sf).collect())
    assert got == sorted(con.execute(ORACLES["s8_workload"]).fetchall()) and {r[0] for r in got} == {"node", "edge", "image", "file"}
