"""A whole generation as text for people; never read back."""

from __future__ import annotations

from .. import schema
from ..functions import describe
from ..functions.text import escape
from ..topology import Topology
from .grammar import ref_text


def render(t: Topology) -> str:
    h = t.header
    out = [f"generation {h.generation}", f"parent {h.parent_generation} {h.parent_digest}", f"digest {t.digest}", f"facility {ref_text(h.facility)}", f"provenance producer={escape(h.producer)} origin={h.origin} witness={escape(h.witness)} authority-epoch={h.authority_epoch}"]
    out += [r.line for r in t.nodes.orderBy("node_id").select(describe.node().alias("line")).toLocalIterator()]
    out += [r.line for r in t.edges.orderBy("edge_id").select(describe.edge().alias("line")).toLocalIterator()]
    out += [f"alias {r.alias_id} -> {r.target}" for r in t.aliases.orderBy("alias_id").toLocalIterator()]
    for g in t.groups.orderBy("group_id").toLocalIterator():
        members = [m.declared for m in t.group_members.where(t.group_members.group_id == g.group_id).orderBy("member_index").toLocalIterator()]
        out.append(f"group {g.group_id} scheme={g.scheme} scope={g.scope} members={','.join(members)}")
    for c in t.changeovers.orderBy("changeover_id").toLocalIterator():
        members = [f"{m.node}.{m.port}" for m in t.changeover_members.where(t.changeover_members.changeover_id == c.changeover_id).orderBy("member_index").toLocalIterator()]
        out.append(f"changeover {c.changeover_id} max={c.max_concurrent} members={','.join(members)}")
    return "\n".join([*out, f"claim boundary: {schema.POSTURE}", ""])
