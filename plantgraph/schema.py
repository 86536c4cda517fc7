"""The data model: vocabularies, legality matrices, limits and DataFrame schemas.

Everything that must equal the format's definition stands here as fixed values, in natural order.
A token's ordinal is its place in its list; ports, kinds and codes order by ordinal, not by text.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import types as T

SCHEMA_VERSION = 1
VERSION = "1.0.0"

# The closed vocabularies.
MEDIA = ["chilled_water", "condenser_water", "glycol", "process_water", "refrigerant", "facility_water", "air"]
PLANT_KINDS = ["chiller_plant", "heat_rejection_plant", "hybrid_plant", "district_supply"]
CHILLER_KINDS = ["centrifugal", "screw", "scroll", "absorption", "magnetic_bearing"]
PUMP_KINDS = ["centrifugal", "vertical_turbine", "positive_displacement"]
PUMP_ROLES = ["duty", "standby", "jockey"]
LOOP_KINDS = ["primary", "secondary", "condenser_water", "chilled_water", "glycol", "process_water", "heat_rejection"]
CDU_KINDS = ["rack_cdu", "row_cdu", "in_row_cdu", "in_rack_cdu"]
PLACEMENTS = ["perimeter", "in_row", "overhead", "rear_door"]
MANIFOLD_KINDS = ["supply", "return", "combined"]
BRANCH_KINDS = ["rack_branch", "zone_branch", "equipment_branch"]
ZONE_CLASSES = ["cold_aisle", "hot_aisle", "room", "rack", "pod", "plenum"]
SINK_KINDS = ["rack_load", "device_load", "facility_load"]
SOURCE_KINDS = ["facility_water", "ambient_air", "well", "district_cooling", "thermal_store"]
SCHEMES = ["n", "n_plus_one", "two_n", "two_n_plus_one", "distributed_redundant", "concurrently_maintainable"]
SCOPES = ["plant", "chiller", "pump", "cooling_loop", "distribution", "source_path", "air_handling"]
REF_KINDS = ["facility", "rack", "asset", "location", "failure_domain", "consumer", "registry", "evidence"]
NODE_KINDS = ["cooling_plant", "chiller", "pump", "cooling_loop", "cdu", "crah", "crac", "manifold", "branch", "thermal_zone", "cooling_sink", "cooling_source"]
PORTS = ["supply_out", "source_in", "heat_out", "return_in", "terminal", "container", "contained", "server", "served"]
EDGE_KINDS = ["supplies", "returns", "serves", "pumps", "contains", "depends_on"]
ORIGINS = ["authored", "imported", "reconciled", "recovered"]
EXCLUDED_CLAIMS = ["component_running", "medium_flowing", "path_usable_capacity", "redundant_source_eligible", "zone_thermally_safe", "actuation_authority", "failover_authority", "airflow_policy", "liquid_cooling_control", "facility_placement", "power_state"]
EVIDENCE_KINDS = ["operating_state", "flow_observation", "capacity_statement", "source_eligibility", "thermal_safety_statement", "actuation_command", "failover_decision", "airflow_policy_statement", "liquid_cooling_policy", "placement_decision", "power_state_observation"]
POSTURE = "structural connectivity only: operating state, flow, capacity, source eligibility, thermal safety, actuation, failover, airflow policy, liquid-cooling control, placement and power state are not owned by this component"
BOUNDARY = "generation-bound structural model of data-centre cooling connectivity; no operating state, no flow, no capacity, no thermal safety, no actuation"

#: vocabulary of the sub-kind of each node kind, and the key it goes by in documents
SUBKINDS = {
    "cooling_plant": ("kind", PLANT_KINDS), "chiller": ("kind", CHILLER_KINDS), "pump": ("kind", PUMP_KINDS), "cooling_loop": ("kind", LOOP_KINDS),
    "cdu": ("kind", CDU_KINDS), "crah": ("placement", PLACEMENTS), "crac": ("placement", PLACEMENTS), "manifold": ("kind", MANIFOLD_KINDS),
    "branch": ("kind", BRANCH_KINDS), "thermal_zone": ("class", ZONE_CLASSES), "cooling_sink": ("kind", SINK_KINDS), "cooling_source": ("kind", SOURCE_KINDS),
}
HYDRONIC = ["cooling_plant", "chiller", "cooling_loop", "cdu", "manifold", "branch"]
HAS_MEDIUM = [*HYDRONIC, "crah", "crac", "cooling_source"]
HAS_DESIGN = [*HYDRONIC, "cooling_source"]
HAS_MAX = [*HYDRONIC, "crah", "crac", "cooling_sink"]

# The legality matrices.
_FLOW = ["supply_out", "source_in", "heat_out", "return_in", "terminal"]
PORTS_OF = {
    "cooling_plant": [*_FLOW, "container", "contained"],
    "chiller": [*_FLOW, "container", "contained"],
    "pump": ["terminal", "contained"],
    "cooling_loop": [*_FLOW, "container", "contained", "server"],
    "cdu": [*_FLOW, "container", "contained", "server"],
    "crah": ["source_in", "heat_out", "terminal", "contained", "server"],
    "crac": ["source_in", "heat_out", "terminal", "contained", "server"],
    "manifold": [*_FLOW, "container", "contained", "server"],
    "branch": [*_FLOW, "container", "contained", "server"],
    "thermal_zone": ["terminal", "container", "contained", "served"],
    "cooling_sink": ["source_in", "heat_out", "terminal", "contained", "served"],
    "cooling_source": ["supply_out", "return_in", "terminal"],
}
SUPPLIERS = ["cooling_source", "cooling_plant", "chiller", "cooling_loop", "manifold", "branch", "cdu"]
CONSUMERS = ["cooling_plant", "chiller", "cooling_loop", "manifold", "branch", "cdu", "crah", "crac", "cooling_sink"]
HEAT_REJECTORS = CONSUMERS
RETURN_TARGETS = SUPPLIERS
SERVERS = ["crah", "crac", "cdu", "cooling_loop", "manifold", "branch"]
SERVED = ["thermal_zone", "cooling_sink"]
PUMP_HOSTS = ["cooling_loop", "manifold", "branch"]
CONTAINS = {
    "cooling_plant": ["chiller", "pump", "cooling_loop", "manifold", "cdu"],
    "cooling_loop": ["pump", "manifold", "branch", "chiller", "cdu"],
    "chiller": ["pump"],
    "cdu": ["pump"],
    "manifold": ["branch", "pump", "cdu"],
    "branch": ["pump", "cdu"],
    "thermal_zone": ["cooling_sink", "crah", "crac", "cdu"],
}
NEEDS_CONTAINER = ["branch", "cooling_sink"]
MEMBER_KINDS = [k for k in NODE_KINDS if k != "thermal_zone"]
SCOPE_KINDS = {
    "plant": ["cooling_plant"], "chiller": ["chiller"], "pump": ["pump"], "cooling_loop": ["cooling_loop"],
    "distribution": ["manifold", "branch", "cdu"], "source_path": ["cooling_source"], "air_handling": ["crah", "crac"],
}

# Stable error codes, in order, by category.
CODES = [
    "ok", "invalid_argument", "malformed_identifier", "invalid_utf8", "text_too_long", "unknown_enum_token", "missing_field", "duplicate_field", "malformed_record",
    "unsupported_schema_version", "count_mismatch", "truncated_input", "digest_mismatch", "limit_exceeded", "empty_input", "malformed_number", "quantity_out_of_range",
    "not_found", "identity_conflict", "duplicate_identifier", "alias_cycle", "alias_target_missing", "self_edge", "duplicate_edge", "endpoint_missing",
    "invalid_port_for_kind", "invalid_edge_endpoint_pair", "invalid_edge_kind_pair", "ambiguous_parentage", "containment_cycle", "containment_kind_invalid",
    "missing_container", "group_member_kind_invalid", "group_member_duplicate", "group_member_missing", "group_empty", "group_redundancy_unproven",
    "group_scope_invalid", "group_independent_path_unproven", "changeover_member_invalid", "changeover_member_duplicate", "changeover_cardinality",
    "constraint_unsatisfied", "isolated_element", "zone_service_absent", "medium_mismatch", "temperature_incompatible", "loop_kind_mismatch", "zone_service_invalid",
    "supply_cycle", "return_cycle", "service_cycle", "dependency_cycle", "pump_attachment_invalid", "sink_feed_absent", "plant_boundary_invalid",
    "source_terminal_invalid", "return_target_invalid", "generation_mismatch", "stale_base_generation", "stale_authority_epoch", "stale_writer_incarnation",
    "store_locked", "store_closed", "store_not_found", "store_not_empty", "store_mismatch", "store_read_only", "not_initialized", "generation_already_exists",
    "generation_not_retained", "generation_floor_violation", "head_missing", "head_corrupt", "recovery_required", "recovery_unavailable", "integrity_failure",
    "publication_incomplete", "idempotency_conflict", "idempotency_evicted", "io_error", "path_invalid", "path_traversal", "path_not_regular", "path_unsafe_name", "internal_error",
]
_STRUCTURE = CODES[CODES.index("not_found") : CODES.index("return_target_invalid") + 1]
_BY_CATEGORY = {
    "authority": ["generation_mismatch", "stale_base_generation", "stale_authority_epoch", "stale_writer_incarnation", "generation_already_exists", "generation_floor_violation", "idempotency_conflict", "idempotency_evicted"],
    "lifecycle": ["store_locked", "store_closed", "store_not_found", "store_not_empty", "store_mismatch", "store_read_only", "not_initialized"],
    "persistence": ["generation_not_retained", "head_missing", "head_corrupt", "recovery_required", "recovery_unavailable", "integrity_failure", "publication_incomplete", "io_error"],
    "limit": ["limit_exceeded"],
    "internal": ["internal_error"],
    "ok": ["ok"],
    "structure": _STRUCTURE,
}
CATEGORY = {c: "argument" for c in CODES} | {c: k for k, own in _BY_CATEGORY.items() for c in own}


@dataclass(frozen=True)
class Limits:
    """Bounds of tables and queries. None means none: the profile for large graphs."""

    nodes: int | None = 100_000
    edges: int | None = 200_000
    groups: int | None = 4_096
    members: int | None = 4_096
    aliases: int | None = 32_768
    references: int = 16
    changeovers: int | None = 4_096
    changeover_members: int | None = 1_024
    evidence: int = 64
    traversal: int | None = 100_000
    depth: int | None = 512
    results: int | None = 16_384
    paths: int | None = 512
    path_length: int = 128
    subjects: int = 64
    diff_entries: int | None = 200_000
    search: int | None = 4_096


REFERENCE = Limits()
UNBOUNDED = replace(REFERENCE, nodes=None, edges=None, groups=None, members=None, aliases=None, changeovers=None, changeover_members=None, traversal=None, depth=None, results=None, paths=None, diff_entries=None, search=None)

U64 = T.DecimalType(20, 0)
U64_MAX = (1 << 64) - 1
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType()}


def _fields(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(","))])


REF = T.StructType([T.StructField("kind", T.StringType()), T.StructField("identity", T.StringType()), T.StructField("generation", U64)])

NODES = _fields("node_id string, kind string, subkind string, pump_role string, medium string, design_supply_mc bigint, max_supply_mc bigint").add("consumer", REF).add("display_name", T.StringType()).add("refs", T.ArrayType(REF))
EDGES = _fields("edge_id string, kind string, from_node string, from_port string, to_node string, to_port string")
GROUPS = _fields("group_id string, scheme string, scope string, display_name string, basis string, require_distinct_failure_domains boolean, require_independent_sources boolean")
MEMBERS = _fields("group_id string, member_index int, node string, declared string").add("failure_domain", REF)
ALIASES = _fields("alias_id string, target string")
CHANGEOVERS = _fields("changeover_id string, display_name string, max_concurrent bigint")
CHANGEOVER_MEMBERS = _fields("changeover_id string, member_index int, node string, port string")
EVIDENCE = _fields("kind string, producer string").add("subject", REF).add("generation", U64).add("observation", U64)
TABLES = {"nodes": NODES, "edges": EDGES, "groups": GROUPS, "group_members": MEMBERS, "aliases": ALIASES, "changeovers": CHANGEOVERS, "changeover_members": CHANGEOVER_MEMBERS, "evidence": EVIDENCE}
HEADER = T.StructType().add("facility", REF).add("producer", T.StringType()).add("origin", T.StringType()).add("witness", T.StringType()).add("source", REF).add("authority_epoch", U64)


def plain(value, t: T.DataType):
    """A value as Arrow takes it: tuples of a struct as dicts."""
    if value is None:
        return None
    if isinstance(t, T.StructType):
        return as_dict(value, t)
    if isinstance(t, T.ArrayType):
        return [plain(v, t.elementType) for v in value]
    return Decimal(value) if isinstance(t, T.DecimalType) else value


def as_dict(row: tuple, kind: T.StructType) -> dict:
    return {f.name: plain(v, f.dataType) for f, v in zip(kind.fields, row, strict=True)}
