"""A small facility as a document, and plain-Python models of the graph rules."""

from collections import defaultdict

HEAD = 'facility facility:dc-1@7\nprovenance producer=tests origin=authored witness="hand written"\n'
BODY = """
node src:w cooling_source kind=facility_water medium=chilled_water design-supply=6.000C
node src:x cooling_source kind=well medium=chilled_water
node plant:a cooling_plant kind=chiller_plant medium=chilled_water max-supply=9.000C name="Plant \\"A\\""
node plant:b cooling_plant kind=chiller_plant medium=chilled_water
node loop:1 cooling_loop kind=primary medium=chilled_water
node loop:2 cooling_loop kind=secondary
node pump:1 pump kind=centrifugal role=duty
node pump:2 pump kind=screw-less role=duty
node br:1 branch kind=rack_branch
node cdu:1 cdu kind=row_cdu
node sink:1 cooling_sink kind=rack_load consumer=consumer:rack-1@3 max-supply=27.000
node sink:2 cooling_sink kind=rack_load consumer=rack-2
node crah:1 crah placement=in_row
node zone:1 thermal_zone class=room
node zone:2 thermal_zone class=rack
edge e01 supplies src:w.supply_out -> plant:a.source_in
edge e02 supplies src:x.supply_out -> plant:b.source_in
edge e03 supplies plant:a.supply_out -> loop:1.source_in
edge e04 supplies plant:b.supply_out -> loop:1.source_in
edge e05 supplies loop:1.supply_out -> loop:2.source_in
edge e06 supplies loop:2.supply_out -> br:1.source_in
edge e07 supplies loop:1.supply_out -> br:1.source_in
edge e08 supplies br:1.supply_out -> cdu:1.source_in
edge e09 supplies cdu:1.supply_out -> sink:1.source_in
edge e10 supplies plant:a.supply_out -> crah:1.source_in
edge r01 returns sink:1.heat_out -> cdu:1.return_in
edge r02 returns cdu:1.heat_out -> br:1.return_in
edge r03 returns br:1.heat_out -> loop:1.return_in
edge r04 returns loop:1.heat_out -> plant:a.return_in
edge r05 returns plant:a.heat_out -> src:w.return_in
edge c01 contains loop:1.container -> br:1.contained
edge c02 contains zone:1.container -> sink:1.contained
edge c03 contains zone:1.container -> sink:2.contained
edge c04 contains loop:1.container -> pump:1.contained
edge s01 serves crah:1.server -> zone:1.served
edge p01 pumps loop:1.supply_out -> pump:1.terminal
edge p02 pumps loop:2.supply_out -> pump:2.terminal
alias main-loop loop:1
group g:plants scope=plant scheme=n_plus_one require-independent-sources plant:a@failure_domain:fd-1 plant:b@failure_domain:fd-2
group g:pumps scope=pump name="Pumps" pump:1 pump:2
changeover x:1 max=1 plant:a.source_in plant:b.source_in
""".replace("screw-less", "vertical_turbine")
DOCUMENT = HEAD + BODY


def edges(document, *kinds):
    out = []
    for line in document.splitlines():
        w = line.split()
        if w and w[0] == "edge" and w[2] in kinds:
            out.append((w[1], w[3].rpartition(".")[0], w[5].rpartition(".")[0], w[3].rpartition(".")[2], w[5].rpartition(".")[2]))
    return sorted(out)


def levels(document, start, forward):
    """Breadth-first rows (node, depth, parent, edge, port), as a sorted search finds them."""
    step = defaultdict(list)
    for e, a, b, ap, bp in edges(document, "supplies"):
        x, y, port = (a, b, bp) if forward else (b, a, ap)
        step[x].append((e, y, port))
    seen, frontier, out, depth = {start}, [start], [], 0
    while frontier:
        depth, ahead = depth + 1, []
        for x in sorted(frontier):
            for e, y, port in sorted(step[x]):
                if y not in seen:
                    seen.add(y)
                    ahead.append(y)
                    out.append((y, depth, x, e, port))
        frontier = ahead
    return out


def paths(document, a, b, kind):
    step = defaultdict(list)
    for e, x, y, *_ in edges(document, kind):
        step[x].append((e, y))
    out = []

    def walk(x, own, nodes):
        if x == b:
            out.append(own)
            return
        for e, y in step[x]:
            if y not in nodes:
                walk(y, [*own, e], {*nodes, y})

    walk(a, [], {a})
    return sorted(out)


def step_table(own, kind):
    """Out-edges (edge, kind, target) of each node in edge order, of (edge, kind, src, dst)."""
    out = defaultdict(list)
    for e, k, x, y in sorted(own):
        out[x].append((e, k == kind, y))
    return out


def sequential_paths(own, a, b, most, search, length):
    """Paths as a search finds them one step at a time, and whether a bound ended it."""
    out, found, state = step_table(own, "supplies"), [], {"left": search, "cut": False}

    def go(x, edges_, nodes):
        if len(found) >= most or state["cut"]:
            state["cut"] = True
            return
        if x == b:
            found.append(edges_)
            return
        if len(edges_) >= length:
            state["cut"] = True
            return
        for e, follow, y in out[x]:
            if state["left"] == 0:
                state["cut"] = True
                return
            state["left"] -= 1
            if follow and y not in nodes:
                go(y, [*edges_, e], [*nodes, y])
                if state["cut"]:
                    return

    if a != b:
        go(a, [], [a])
    return found, state["cut"]


def sequential_return(own, a, b, search, length):
    """The way a search that opens no node twice finds first, and whether a bound kept it from one."""
    out, seen, state = step_table(own, "returns"), {a}, {"left": max(1, search), "cut": False, "dead": False}

    def go(x, edges_):
        if x == b:
            return edges_
        for e, follow, y in out[x]:
            if state["left"] == 0:
                state["cut"] = state["dead"] = True
                return None
            state["left"] -= 1
            if not follow or y in seen:
                continue
            if len(edges_) >= length:
                state["cut"] = True
                continue
            seen.add(y)
            got = go(y, [*edges_, e])
            if got is not None or state["dead"]:
                return got
        return None

    got = go(a, [])
    return got, state["cut"] and got is None


def greedy_routes(own, a, b, most, search=10**9):
    """Breadth-first routes over edges that no earlier one used, and whether the budget ended the search."""
    out, used, routes = step_table(own, "supplies"), set(), []
    while len(routes) < most and a != b:
        via, level = {a: None}, [a]
        while level and b not in via:
            ahead = []
            for x in level:
                for e, follow, y in out[x]:
                    if search == 0:
                        return routes, True
                    search -= 1
                    if follow and e not in used and y not in via:
                        via[y] = (e, x)
                        if y == b:
                            break
                        ahead.append(y)
                if b in via:
                    break
            level = sorted(ahead)
        if b not in via:
            break
        own_, x = [], b
        while via[x]:
            e, x = via[x]
            own_.append(e)
        used.update(own_)
        routes.append(own_[::-1])
    return routes, False


def most_routes(own, a, b):
    """The greatest number of edge-disjoint routes, by single augmenting paths."""
    room = defaultdict(lambda: defaultdict(int))
    for _, k, x, y in own:
        if k == "supplies":
            room[x][y] += 1
            room[y][x] += 0
    n = 0
    while a != b:
        via, todo = {a: None}, [a]
        while todo and b not in via:
            x = todo.pop()
            for y, c in room[x].items():
                if c and y not in via:
                    via[y] = x
                    todo.append(y)
        if b not in via:
            break
        y = b
        while via[y] is not None:
            x = via[y]
            room[x][y] -= 1
            room[y][x] += 1
            y = x
        n += 1
    return n


def first_cycle(own):
    """Edges (edge, src, dst), sorted, of the cycle that a depth-first search in ascending order closes first."""
    out = defaultdict(list)
    for e, x, y in sorted(own):
        out[x].append((e, y))
    done, on, via = set(), [], []

    def go(x):
        on.append(x)
        for e, y in out[x]:
            if y in on:
                return sorted([*via[on.index(y) :], e])
            if y not in done:
                via.append(e)
                got = go(y)
                if got:
                    return got
                via.pop()
        on.pop()
        done.add(x)
        return []

    for root in sorted({n for _, x, y in own for n in (x, y)}):
        if root not in done:
            got = go(root)
            if got:
                return got
    return []


def strong(own):
    """(node: least node of those that reach it and that it reaches) of the nodes on a cycle."""
    out = defaultdict(set)
    for _, x, y in own:
        out[x].add(y)

    def ahead(x):
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    reach = {x: ahead(x) for x in list(out)}
    return {x: min(y for y in own_ if x in reach.get(y, ())) for x, own_ in reach.items() if x in own_}
