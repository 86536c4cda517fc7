"""The rules a draft must keep, in fourteen stages. Every stage always runs; each is a DataFrame of
issues (stage, severity, code, code_ordinal, message, subject).

Rules over one table are filters; rules between tables are joins with the small legality tables.
Ids are not unique in a draft before stage 1 has passed, so lookups use one row per name.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..errors import PlantError
from ..functions import text
from ..plans.steps import Rounds
from ..topology import Topology
from . import cycles
from . import traverse as tr
from .adjacency import among

STAGES = ["shape", "identity", "endpoint", "role", "circuit", "medium", "containment", "attachment", "service", "redundancy", "changeover", "dependency", "binding", "completeness"]
ISSUE = "stage int, severity string, code string, code_ordinal int, message string, subject string"
ERROR, WARNING = "error", "warning"


def _issues(df: DataFrame, stage: str, code: str | Column, message: str | Column, subject: str | Column, severity: str = ERROR) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    message = F.lit(message) if isinstance(message, str) else message
    subject = F.col(subject) if isinstance(subject, str) else subject
    ordinal = F.array_position(F.array(*map(F.lit, schema.CODES)), code).cast("int") - 1
    return df.select(F.lit(STAGES.index(stage)).alias("stage"), F.lit(severity).alias("severity"), code.alias("code"), ordinal.alias("code_ordinal"), message.alias("message"), F.coalesce(subject, F.lit("")).alias("subject"))


def _all(t: Topology, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else t.spark.createDataFrame([], ISSUE)


def _one(t: Topology, stage: str, code: str, message: str, subject: str) -> DataFrame:
    return _issues(t.spark.range(1), stage, code, message, F.lit(subject))


def _choose(*rules: tuple[Column, str, str]) -> tuple[Column, Column]:
    """Code and message of the first rule that applies; null where none does."""
    code, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, c, m in reversed(rules):
        code, message = F.when(when, c).otherwise(code), F.when(when, m).otherwise(message)
    return code, message


def _none(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


# -- 0 -------------------------------------------------------------------------------------------
def shape(t: Topology) -> DataFrame:
    lim, parts = t.limits, []

    def rule(df: DataFrame, when: Column, code: str, message: str, subject: str) -> None:
        parts.append(_issues(df.where(when), "shape", code, message, subject))

    counted = [("nodes", lim.nodes, "node"), ("edges", lim.edges, "edge"), ("groups", lim.groups, "redundancy group"), ("aliases", lim.aliases, "alias"), ("changeovers", lim.changeovers, "changeover group"), ("evidence", lim.evidence, "evidence binding")]
    for table, most, what in counted:
        if most is not None and table in t.tables and getattr(t, table).limit(most + 1).count() > most:
            parts.append(_one(t, "shape", "limit_exceeded", f"more {what} records than the bound", f"table:{what}"))
    if parts:
        return _all(t, parts)
    n = t.nodes
    rule(n, ~F.coalesce(text.identifier(F.col("node_id")), F.lit(False)), "malformed_identifier", "node id does not follow the identifier grammar", "node_id")
    rule(n, ~_none("display_name") & ~text.display_text(F.col("display_name"), 192), "invalid_utf8", "node name is not display text", "node_id")
    rule(n, F.size(F.coalesce("refs", F.array().cast(schema.NODES["refs"].dataType))) > lim.references, "limit_exceeded", "node has more references than the bound", "node_id")
    sink = n.where("kind = 'cooling_sink'")
    rule(sink, F.coalesce(F.col("consumer.identity"), F.lit("")) == "", "missing_field", "sink names no consumer", "node_id")
    rule(sink, (F.coalesce(F.col("consumer.identity"), F.lit("")) != "") & (F.col("consumer.kind") != "consumer"), "invalid_argument", "sink's consumer is a reference of another kind", "node_id")
    for c in ("design_supply_mc", "max_supply_mc"):
        rule(n, ~F.col(c).between(text.LEAST_MC, text.MOST_MC), "quantity_out_of_range", "declared temperature is out of range", "node_id")
    e = t.edges
    rule(e, ~F.coalesce(text.identifier(F.col("edge_id")), F.lit(False)), "malformed_identifier", "edge id does not follow the identifier grammar", "edge_id")
    rule(e, _none("from_node") | _none("to_node"), "endpoint_missing", "edge endpoint names no node", "edge_id")
    rule(e, ~F.col("from_port").isin(*schema.PORTS) | ~F.col("to_port").isin(*schema.PORTS), "invalid_port_for_kind", "edge endpoint has an unknown port", "edge_id")
    g = t.groups
    size = t.group_members.groupBy("group_id").agg(F.count("*").alias("m"))
    sized = g.join(size, "group_id", "left")
    rule(g, ~F.coalesce(text.identifier(F.col("group_id")), F.lit(False)), "malformed_identifier", "group id does not follow the identifier grammar", "group_id")
    rule(g, ~_none("display_name") & ~text.display_text(F.col("display_name"), 192), "invalid_utf8", "group name is not display text", "group_id")
    rule(g, ~_none("basis") & ~text.display_text(F.col("basis"), 512), "invalid_utf8", "group basis is not display text", "group_id")
    rule(sized, F.col("m").isNull(), "group_empty", "group has no member", "group_id")
    if lim.members is not None:
        rule(sized, F.col("m") > lim.members, "limit_exceeded", "group has more members than the bound", "group_id")
    rule(g, ~F.col("scheme").isin(*schema.SCHEMES), "unknown_enum_token", "unknown redundancy scheme", "group_id")
    rule(g, ~F.col("scope").isin(*schema.SCOPES), "unknown_enum_token", "unknown redundancy scope", "group_id")
    m = t.group_members
    rule(m, _none("node") | _none("declared"), "group_member_missing", "member names no node", "group_id")
    rule(m, ~_none("node") & ~_none("declared") & ~text.display_text(F.col("declared"), 128), "malformed_identifier", "member's spelling is not identifier text", "group_id")
    domain = F.col("failure_domain.identity")
    rule(m, F.col("failure_domain").isNotNull() & ((domain == "") | (F.octet_length(domain) > 512) | F.contains(domain, F.lit("\x00"))), "group_member_missing", "member's failure domain is no external identity", "group_id")
    a = t.aliases
    rule(a, ~F.coalesce(text.identifier(F.col("alias_id")), F.lit(False)), "malformed_identifier", "alias id does not follow the identifier grammar", "alias_id")
    rule(a, ~F.coalesce(text.identifier(F.col("target")), F.lit(False)), "malformed_identifier", "alias target does not follow the identifier grammar", "alias_id")
    c = t.changeovers
    csize = c.join(t.changeover_members.groupBy("changeover_id").agg(F.count("*").alias("m")), "changeover_id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    most = lim.changeover_members
    rule(c, ~F.coalesce(text.identifier(F.col("changeover_id")), F.lit(False)), "malformed_identifier", "changeover id does not follow the identifier grammar", "changeover_id")
    rule(c, ~_none("display_name") & ~text.display_text(F.col("display_name"), 192), "invalid_utf8", "changeover name is not display text", "changeover_id")
    rule(csize, F.col("m") < 2, "changeover_cardinality", "a changeover needs two members", "changeover_id")
    over = F.col("m") > most if most is not None else F.lit(False)
    rule(csize, (F.col("m") >= 2) & over, "limit_exceeded", "changeover has more members than the bound", "changeover_id")
    rule(csize, (F.col("m") >= 2) & ~over & ((F.col("max_concurrent") < 1) | (F.col("max_concurrent") >= F.col("m"))), "changeover_cardinality", "max must be at least 1 and below the number of members", "changeover_id")
    rule(t.changeover_members, _none("node") | ~F.col("port").isin(*schema.PORTS), "changeover_member_invalid", "changeover member has no node or an unknown port", "changeover_id")
    h = t.header
    said = [(not h.producer, "missing_field", "provenance names no producer", "provenance"), (bool(h.producer) and not text.is_display_text(h.producer, 128), "invalid_utf8", "producer is not display text", "provenance"), (bool(h.witness) and not text.is_display_text(h.witness, 256), "invalid_utf8", "witness is not display text", "provenance"), (h.origin not in schema.ORIGINS, "unknown_enum_token", "unknown origin", "provenance"), (not h.facility or not h.facility[1], "missing_field", "the facility is not named", "facility")]
    parts += [_one(t, "shape", code, message, subject) for wrong, code, message, subject in said if wrong]
    v = t.evidence
    rule(v, ~F.col("kind").isin(*schema.EVIDENCE_KINDS), "unknown_enum_token", "unknown evidence kind", "producer")
    rule(v, _none("producer") | ~text.display_text(F.col("producer"), 128), "invalid_utf8", "evidence producer is not display text", "producer")
    rule(v, (F.coalesce(F.col("subject.identity"), F.lit("")) == "") | ~F.col("subject.kind").isin(*schema.REF_KINDS), "missing_field", "evidence has no subject", "producer")
    return _all(t, parts)


# -- 1 -------------------------------------------------------------------------------------------
def identity(t: Topology) -> DataFrame:
    parts = []
    for table, key, what in (("nodes", "node_id", "node"), ("edges", "edge_id", "edge"), ("groups", "group_id", "redundancy group"), ("aliases", "alias_id", "alias"), ("changeovers", "changeover_id", "changeover group")):
        twice = getattr(t, table).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(_issues(twice, "identity", "duplicate_identifier", f"{what} id is declared more than once", key))
    ids, names = t.nodes.select("node_id").distinct(), t.aliases.select(F.col("alias_id").alias("target")).distinct()
    parts.append(_issues(t.aliases.join(ids, F.col("alias_id") == F.col("node_id"), "left_semi"), "identity", "identity_conflict", "alias has the id of a node", "alias_id"))
    loose = t.aliases.where(~_none("target")).join(ids.withColumnRenamed("node_id", "target"), "target", "left_anti")
    parts.append(_issues(loose.join(names, "target", "left_semi"), "identity", "alias_cycle", "alias of an alias", "alias_id"))
    parts.append(_issues(loose.join(names, "target", "left_anti"), "identity", "alias_target_missing", "alias target names no node", "alias_id"))
    return _all(t, parts)


# -- 2 -------------------------------------------------------------------------------------------
def endpoint(t: Topology) -> DataFrame:
    e = t.edges_resolved
    parts = [_issues(e.where("src IS NULL"), "endpoint", "endpoint_missing", "edge leaves no known node", "edge_id"), _issues(e.where("dst IS NULL"), "endpoint", "endpoint_missing", "edge enters no known node", "edge_id"), _issues(e.where("src = dst"), "endpoint", "self_edge", "edge from a node to itself", "edge_id")]
    key = "kind, from_node, from_port, to_node, to_port"
    again = t.edges.selectExpr("edge_id", f"row_number() OVER (PARTITION BY {key} ORDER BY edge_id) n").where("n > 1")
    return _all(t, [*parts, _issues(again, "endpoint", "duplicate_edge", "kind and endpoints of another edge", "edge_id")])


def _ends(t: Topology) -> DataFrame:
    """Resolved edges with the attributes of both ends."""
    own = ["kind", "subkind", "medium", "design_supply_mc", "max_supply_mc"]
    n = t.nodes.dropDuplicates(["node_id"])
    a = n.select(F.col("node_id").alias("src"), *(F.col(c).alias(f"a_{c}") for c in own))
    b = n.select(F.col("node_id").alias("dst"), *(F.col(c).alias(f"b_{c}") for c in own))
    return t.edges_resolved.where("src IS NOT NULL AND dst IS NOT NULL").join(a, "src").join(b, "dst")


def _port_ok(kind: str, port: str) -> Column:
    return reduce(lambda x, y: x | y, ((F.col(kind) == k) & F.col(port).isin(*v) for k, v in schema.PORTS_OF.items()))


# -- 3 -------------------------------------------------------------------------------------------
def role(t: Topology) -> DataFrame:
    e = _ends(t).where("src <> dst")
    k, a, b, ap, bp = (F.col(c) for c in ("kind", "a_kind", "b_kind", "from_port", "to_port"))
    held = reduce(lambda x, y: x | y, ((a == c) & b.isin(*v) for c, v in schema.CONTAINS.items()))
    rules = [
        ((k == "supplies") & ~a.isin(*schema.SUPPLIERS), "invalid_edge_kind_pair", "the first element cannot deliver medium"),
        ((k == "supplies") & (b == "cooling_source"), "source_terminal_invalid", "a source is not supplied"),
        ((k == "supplies") & ~b.isin(*schema.CONSUMERS), "invalid_edge_kind_pair", "the second element cannot receive medium"),
        ((k == "returns") & ~a.isin(*schema.HEAT_REJECTORS), "invalid_edge_kind_pair", "the first element cannot reject heat"),
        ((k == "returns") & ~b.isin(*schema.RETURN_TARGETS), "return_target_invalid", "the second element takes no return"),
        ((k == "serves") & (a == "cooling_plant"), "plant_boundary_invalid", "a plant serves through loops only"),
        ((k == "serves") & ~a.isin(*schema.SERVERS), "zone_service_invalid", "the first element cannot serve"),
        ((k == "serves") & ~b.isin(*schema.SERVED), "zone_service_invalid", "the second element cannot be served"),
        ((k == "pumps") & ~a.isin(*schema.PUMP_HOSTS), "pump_attachment_invalid", "the first element cannot host a pump"),
        ((k == "pumps") & (b != "pump"), "pump_attachment_invalid", "the second element is no pump"),
        ((k == "contains") & ~a.isin(*schema.CONTAINS), "containment_kind_invalid", "the first element contains nothing"),
        ((k == "contains") & ~held, "containment_kind_invalid", "the first element does not contain such elements"),
        (~k.isin(*schema.EDGE_KINDS), "unknown_enum_token", "unknown edge kind"),
        (~_port_ok("a_kind", "from_port"), "invalid_port_for_kind", "the first element has no such port"),
        (~_port_ok("b_kind", "to_port"), "invalid_port_for_kind", "the second element has no such port"),
        ((k == "supplies") & ((ap != "supply_out") | (bp != "source_in")), "invalid_edge_endpoint_pair", "supplies go from supply_out to source_in"),
        ((k == "returns") & ((ap != "heat_out") | (bp != "return_in")), "invalid_edge_endpoint_pair", "returns go from heat_out to return_in"),
        ((k == "serves") & ((ap != "server") | (bp != "served")), "invalid_edge_endpoint_pair", "serves go from server to served"),
        ((k == "pumps") & (~ap.isin("supply_out", "return_in") | (bp != "terminal")), "pump_attachment_invalid", "pumps go from supply_out or return_in to terminal"),
        ((k == "contains") & ((ap != "container") | (bp != "contained")), "invalid_edge_endpoint_pair", "contains go from container to contained"),
        ((k == "depends_on") & ((ap != "terminal") | (bp != "terminal")), "invalid_edge_endpoint_pair", "dependencies join terminals"),
    ]
    code, message = _choose(*rules)
    e = e.select("edge_id", code.alias("c"), message.alias("m")).where("c IS NOT NULL")
    return _issues(e, "role", F.col("c"), F.col("m"), "edge_id")


#: which rule, over which kinds, of which stage and code
CYCLES = {
    "supplies": ("circuit", "supply_cycle", ("supplies",)),
    "returns": ("circuit", "return_cycle", ("returns",)),
    "contains": ("containment", "containment_cycle", ("contains",)),
    "serves": ("service", "service_cycle", ("serves",)),
    "depends": ("dependency", "dependency_cycle", ("depends_on",)),
    "holds": ("dependency", "dependency_cycle", ("depends_on", "contains")),
}


def _cycles(t: Topology, stage: str) -> list[DataFrame]:
    """The cycle rules of a stage; all rules share one search."""
    found = t._once("cycles", lambda: cycles.cycles(t, {name: kinds for name, (_, _, kinds) in CYCLES.items()}))
    own = {name: code for name, (of, code, _) in CYCLES.items() if of == stage}
    code = reduce(lambda x, y: F.when(F.col("name") == y[0], y[1]).otherwise(x), own.items(), F.lit(""))
    return [_issues(found.where(F.col("name").isin(*own)), stage, code, F.concat(F.lit("edges close a cycle: "), F.array_join("edges", ", ")), F.element_at("edges", 1))]


# -- 4 -------------------------------------------------------------------------------------------
def circuit(t: Topology) -> DataFrame:
    return _all(t, _cycles(t, "circuit"))


# -- 5 -------------------------------------------------------------------------------------------
def medium(t: Topology) -> DataFrame:
    e = _ends(t).where("kind IN ('supplies', 'returns')")
    supplies = F.col("kind") == "supplies"
    code, message = _choose(
        (F.col("a_medium") != F.col("b_medium"), "medium_mismatch", "declared media differ"),
        (supplies & (F.col("a_design_supply_mc") > F.col("b_max_supply_mc")), "temperature_incompatible", "declared supply is warmer than the target accepts"),
        (supplies & (F.col("a_kind") == "cooling_loop") & (F.col("b_kind") == "cooling_loop") & (F.col("a_subkind") == "secondary") & (F.col("b_subkind") == "primary"), "loop_kind_mismatch", "a secondary loop supplies a primary one"),
    )
    e = e.select("edge_id", code.alias("c"), message.alias("m")).where("c IS NOT NULL")
    return _issues(e, "medium", F.col("c"), F.col("m"), "edge_id")


# -- 6 -------------------------------------------------------------------------------------------
def containment(t: Topology) -> DataFrame:
    holds = t.of_kind("contains")
    extra = holds.selectExpr("dst", "row_number() OVER (PARTITION BY dst ORDER BY edge_id) n").where("n > 1")
    lone = t.nodes.where(F.col("kind").isin(*schema.NEEDS_CONTAINER)).join(holds.select(F.col("dst").alias("node_id")), "node_id", "left_anti")
    parts = [_issues(extra, "containment", "ambiguous_parentage", "element has more than one container", "dst"), _issues(lone, "containment", "missing_container", "element needs a container", "node_id")]
    return _all(t, parts + _cycles(t, "containment"))


# -- 7 -------------------------------------------------------------------------------------------
def attachment(t: Topology) -> DataFrame:
    n = t.edges_resolved.where("kind = 'pumps' AND dst IS NOT NULL").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"))
    pumps = t.nodes.where("kind = 'pump'").join(n, "node_id", "left").where("n IS NULL OR n > 1")
    message = F.when(F.col("n").isNull(), "pump is installed nowhere").otherwise("pump is installed more than once")
    return _issues(pumps, "attachment", "pump_attachment_invalid", message, "node_id")


# -- 8 -------------------------------------------------------------------------------------------
def service(t: Topology) -> DataFrame:
    return _all(t, _cycles(t, "service"))


# -- 9 -------------------------------------------------------------------------------------------
def redundancy(t: Topology) -> DataFrame:
    label = F.concat_ws("/", "group_id", F.substring(F.when(_none("declared"), F.col("node")).otherwise(F.col("declared")), 1, 128))
    m = t.group_members.join(among(t.lookup, "name", t.group_members).select(F.col("name").alias("node"), "node_id", "kind"), "node", "left").join(t.groups.select("group_id", "scope", "require_distinct_failure_domains", "require_independent_sources"), "group_id")
    fits = reduce(lambda x, y: x | y, ((F.col("scope") == s) & F.col("kind").isin(*v) for s, v in schema.SCOPE_KINDS.items()))
    code, message = _choose(
        (F.col("node_id").isNull(), "group_member_missing", "member names no node"),
        (~F.col("kind").isin(*schema.MEMBER_KINDS), "group_member_kind_invalid", "such elements are in no group"),
        (~fits, "group_scope_invalid", "such elements are not of the group's scope"),
    )
    m = m.withColumns({"c": code, "m": message, "label": label})
    good = m.where("c IS NULL").selectExpr("*", "row_number() OVER (PARTITION BY group_id, node_id ORDER BY member_index) n")
    parts = [_issues(m.where("c IS NOT NULL"), "redundancy", F.col("c"), F.col("m"), "label"), _issues(good.where("n > 1"), "redundancy", "group_member_duplicate", "the same node twice", "label")]
    apart = t.group_members.join(t.groups.where("require_distinct_failure_domains").select("group_id"), "group_id").withColumn("label", F.concat_ws("/", "group_id", F.substring("declared", 1, 128)))
    parts.append(_issues(apart.where("failure_domain IS NULL"), "redundancy", "group_redundancy_unproven", "member has no failure domain", "label"))
    again = apart.where("failure_domain IS NOT NULL").selectExpr("label", "row_number() OVER (PARTITION BY group_id, failure_domain.identity ORDER BY declared) n").where("n > 1")
    parts.append(_issues(again, "redundancy", "group_redundancy_unproven", "member shares its failure domain", "label"))
    # labels follow the place among resolved members, as the format has it
    kept = good.where("n = 1 AND require_independent_sources").selectExpr("group_id", "node_id", "row_number() OVER (PARTITION BY group_id ORDER BY member_index) - 1 i", "count(*) OVER (PARTITION BY group_id) size").where("size >= 2")
    said = t.group_members.selectExpr("group_id", "row_number() OVER (PARTITION BY group_id ORDER BY member_index) - 1 i", "concat_ws('/', group_id, substring(declared, 1, 128)) label")
    kept = kept.join(said, ["group_id", "i"]).withColumn("key", F.concat_ws("\t", "group_id", F.col("i").cast("string")))
    own = tr.source_sets(t, kept.select("key", F.col("node_id").alias("node"))).join(kept.select("key", "group_id", "i", "label"), "key")
    parts.append(_issues(kept.join(own.select("key").distinct(), "key", "left_anti"), "redundancy", "group_independent_path_unproven", "member has no structural source", "label"))
    parts.append(_issues(_sharing(t, own), "redundancy", "group_independent_path_unproven", F.concat(F.lit("members share the source "), "source"), "label"))
    return _all(t, parts)


#: pairs that a task writes, about, and pairs of one member that are written at once
PAIRS, RUN = 4_000_000, 10_000


def _sharing(t: Topology, own: DataFrame) -> DataFrame:
    """(label, source) of each later member of each pair in a group that shares a source, with the least one
    they share; own: (group_id, i, label, source). Members with the same sources are one class, named by its first. The least source is
    found for pairs of classes. A member is then told how many of a class come before it, and dealt out with that number
    to as many tasks as the pairs need, which only write it so often: no pair is joined, held or grouped."""
    rounds = Rounds(t.spark, "sharing")
    sets = rounds.keep(own.groupBy("group_id", "i", "label").agg(F.array_sort(F.collect_set("source")).alias("sources")))
    classes = rounds.keep(sets.groupBy("group_id", "sources").agg(F.min("i").alias("c")))
    members = rounds.keep(sets.join(classes, ["group_id", "sources"]).select("group_id", "c", "i", "label"))
    each = classes.select("group_id", "c", F.explode("sources").alias("source"))
    shared = rounds.keep(each.join(each.withColumnRenamed("c", "d"), ["group_id", "source"]).groupBy("group_id", "c", "d").agg(F.min("source").alias("source")))
    first = members.join(shared, ["group_id", "c"]).select("group_id", "c", "d", "i", F.lit(1).alias("one"), F.lit(None).cast("string").alias("label"), "source")
    later = members.withColumnRenamed("c", "d").join(shared, ["group_id", "d"]).select("group_id", "c", "d", "i", F.lit(0).alias("one"), "label", "source")
    before = first.unionByName(later).withColumn("n", F.expr("sum(one) OVER (PARTITION BY group_id, c, d ORDER BY i, one ROWS UNBOUNDED PRECEDING)"))
    before = rounds.keep(before.where("one = 0 AND n > 0").select("label", "source", "n"))
    rounds.drop_all_but(before)
    pairs = before.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    runs = before.select("label", "source", "n", F.explode(F.expr(f"sequence(0L, n - 1, {RUN}L)")).alias("k")).repartition(tasks, "label", "source", "k")
    return runs.select("label", "source", F.explode(F.expr(f"sequence(1L, least(n - k, {RUN}L))")).alias("x")).select("label", "source")


# -- 10 ------------------------------------------------------------------------------------------
def changeover(t: Topology) -> DataFrame:
    m = t.changeover_members.join(t.lookup.select(F.col("name").alias("node"), "node_id", "kind"), "node", "left").withColumn("label", F.concat_ws("/", "changeover_id", F.substring("node", 1, 128)))
    code, message = _choose(
        (F.col("node_id").isNull(), "changeover_member_invalid", "member names no node"),
        (~_port_ok("kind", "port"), "changeover_member_invalid", "the element has no such port"),
        (F.col("port") != "source_in", "changeover_member_invalid", "a changeover selects between source_in ports"),
    )
    m = m.withColumns({"c": code, "m": message})
    good = m.where("c IS NULL").selectExpr("*", "row_number() OVER (PARTITION BY changeover_id, node_id, port ORDER BY member_index) n")
    used = t.edges_resolved.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("from_port").alias("port")), F.struct(F.col("dst").alias("node_id"), F.col("to_port").alias("port")))).alias("x")).select("x.node_id", "x.port").distinct()
    return _all(t, [_issues(m.where("c IS NOT NULL"), "changeover", F.col("c"), F.col("m"), "label"), _issues(good.where("n > 1"), "changeover", "changeover_member_duplicate", "the same endpoint twice", "label"), _issues(good.where("n = 1").join(used, ["node_id", "port"], "left_anti"), "changeover", "constraint_unsatisfied", "member is on no edge", "label")])


# -- 11 ------------------------------------------------------------------------------------------
def dependency(t: Topology) -> DataFrame:
    return _all(t, _cycles(t, "dependency"))


# -- 12 ------------------------------------------------------------------------------------------
def binding(t: Topology) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, schema.EVIDENCE_KINDS)), F.col("kind"))
    e = t.evidence.withColumns({"at": F.monotonically_increasing_id(), "rank": rank, "body": F.struct("kind", "producer", "subject", "generation", "observation")})
    again = e.selectExpr("producer", "body", "lag(body) OVER (PARTITION BY producer, kind ORDER BY at) before").where("body = before")
    return _issues(again, "binding", "duplicate_field", "the same evidence twice", "producer")


# -- 13 ------------------------------------------------------------------------------------------
def completeness(t: Topology) -> DataFrame:
    e = t.edges_resolved
    touched = e.select(F.explode(F.array("src", "dst")).alias("node_id")).where("node_id IS NOT NULL")

    def lacking(kind: str, edge: str) -> DataFrame:
        return t.nodes.where(F.col("kind") == kind).join(e.where((F.col("kind") == edge) & F.col("dst").isNotNull()).select(F.col("dst").alias("node_id")), "node_id", "left_anti")

    return _all(t, [_issues(t.nodes.join(touched, "node_id", "left_anti"), "completeness", "isolated_element", "element has no edge", "node_id", WARNING), _issues(lacking("cooling_sink", "supplies"), "completeness", "sink_feed_absent", "sink is not supplied", "node_id", WARNING), _issues(lacking("thermal_zone", "serves"), "completeness", "zone_service_absent", "zone is not served", "node_id", WARNING)])


@dataclass
class Report:
    """``issues`` in order of stage, subject, code and message."""

    issues: DataFrame

    def error_count(self) -> int:
        return self.issues.where("severity = 'error'").count()

    def warning_count(self) -> int:
        return self.issues.where("severity = 'warning'").count()

    def valid(self) -> bool:
        return self.issues.where("severity = 'error'").isEmpty()

    def primary(self):
        """The first error, or None."""
        return self.issues.where("severity = 'error'").orderBy("stage", "subject", "code_ordinal", "message").first()

    def check(self) -> None:
        """Raises the first error, with up to eight others as details."""
        rows = self.issues.where("severity = 'error'").orderBy("stage", "subject", "code_ordinal", "message").take(9)
        if rows:
            raise PlantError(rows[0].code, rows[0].message, rows[0].subject, tuple(f"{r.code} {r.subject}" for r in rows[1:]))


def validate(t: Topology) -> Report:
    """All stages on one reading of names and edges; the issues are kept, so a report is made once."""
    rounds = Rounds(t.spark, "validate")
    t = replace(t, _made=dict(t._made))
    names = rounds.keep(t.lookup)
    t._made["lookup"] = names
    t._made["edges"] = rounds.keep(t.edges_resolved)
    every = reduce(DataFrame.unionByName, [globals()[s](t) for s in STAGES])
    issues = rounds.keep(every)
    rounds.drop(names, t._made["edges"])
    return Report(issues.orderBy("stage", "subject", "code_ordinal", "message"))
