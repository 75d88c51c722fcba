"""Path-group packing: evidence is delivered as groups of nodes that the walked paths tie to one ranked root.

Which nodes belong to a root, how useful each is and which fragments support them are joins, aggregates and sorted
arrays over all queries at once. What remains is a budget that depends on what was taken before; it runs per query over
its few groups, each with its fragments.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import written

# Relations that change what holds: a path through one is never left out as useless.
STATE_RELATIONS = ("supersedes", "contradicts")
CARD_CHARS, TOTAL_CHARS = 4000, 24_000
EDGE = "struct<src:string,dst:string,relation:string,sources:array<string>>"


def routes(roots: DataFrame, paths: DataFrame, max_hops: int) -> DataFrame:
    """(query_id, root, root_rn, ref, hop, route, chosen): the way from each root to each node that its query's walked
    paths reach within max_hops: of the shortest ways the one walked first.

    roots: query_id, rn, ref. paths: query_id, at (order of walking), src, dst, relation, sources, chosen.
    """
    step = F.struct("src", "dst", F.col("at").cast("long").alias("at"), F.struct("src", "dst", "relation", "sources").cast(EDGE).alias("edge"), "chosen")
    steps = paths.groupBy("query_id").agg(F.collect_list(step).alias("_steps"))
    start = F.struct(F.col("ref"), F.array().cast("array<long>").alias("walked"), F.lit(0).alias("hop"), F.array().cast(f"array<{EDGE}>").alias("route"), F.lit(False).alias("chosen"))
    # A query's walk is few steps, so all rounds are taken where its rows lie; joins on the query alone leave them there.
    r = roots.join(steps, "query_id", "left").select("query_id", F.col("ref").alias("root"), F.col("rn").alias("root_rn"), "_steps", F.array(start).alias("_seen"), F.array(start).alias("_front"))
    for at_hop in [F.lit(hop).alias("hop") for hop in range(1, max_hops + 1)]:

        def onward(f: Column) -> Column:
            new = F.filter("_steps", lambda s: (s["src"] == f["ref"]) & ~F.exists("_seen", lambda x: x["ref"] == s["dst"]))
            far = lambda s: F.struct(s["dst"].alias("ref"), F.array_append(f["walked"], s["at"]).alias("walked"), at_hop, F.array_append(f["route"], s["edge"]).alias("route"), (f["chosen"] | s["chosen"]).alias("chosen"))
            return F.transform(new, far)

        r = r.withColumn("_near", F.array_sort(F.flatten(F.transform("_front", onward))))
        r = r.withColumn("_front", F.coalesce(F.filter("_near", lambda x, i: (i == 0) | (F.get("_near", i - 1)["ref"] != x["ref"])), F.expr("slice(_front, 1, 0)")))
        r = r.withColumn("_seen", F.concat("_seen", "_front"))
    return r.select("query_id", "root", "root_rn", F.explode("_seen").alias("s")).select("query_id", "root", "root_rn", "s.ref", "s.hop", "s.route", "s.chosen")


def branch_hits(reached: DataFrame, nodes: DataFrame, branches: DataFrame) -> DataFrame:
    """(query_id, ref, hits): which of the query's branches share a term with the node. branches: query_id, branch, terms."""
    asked = branches.select("query_id", "branch", F.explode("terms").alias("term")).distinct()
    refs = reached.select("query_id", "ref").distinct()
    # Written, so that its size is known: few terms are broadcast, and only nodes' terms that some branch asks for are moved.
    wanted = written(asked.select("term").distinct(), "terms")
    terms = nodes.select("ref", F.explode(F.array_distinct("terms")).alias("term")).join(wanted, "term", "left_semi")
    held = refs.join(terms, "ref")
    return held.join(asked, ["query_id", "term"]).groupBy("query_id", "ref").agg(F.collect_set("branch").alias("hits"))


def useful(reached: DataFrame, nodes: DataFrame, branches: DataFrame, seen: DataFrame, roots: DataFrame) -> DataFrame:
    """(query_id, root, root_rn, members, edges): each root with the nodes worth delivering beside it, in order of use.

    A node is of use if its body was seen on the walk, if a chosen path or one that states a change leads to it, or if it
    answers a branch of the question that the root does not. Changes come first, then seen nodes, then by branches
    gained, hops, rank and name. Members are all ends of the ways to useful nodes, so each way is whole.
    """
    by_query = lambda df, value: df.groupBy("query_id").agg(F.collect_list(F.struct("ref", value)).alias("_list"))
    hits = by_query(branch_hits(reached, nodes, branches), "hits").select("query_id", F.map_from_entries("_list").alias("_hits"))
    ranks = by_query(roots.where("ref is not null").groupBy("query_id", "ref").agg(F.min("rn").alias("rn")), "rn").select("query_id", F.map_from_entries("_list").alias("_ranks"))
    bodies = seen.groupBy("query_id").agg(F.collect_set("ref").alias("_bodies"))
    none = F.array().cast("array<string>")
    r = reached.join(hits, "query_id", "left").join(bodies, "query_id", "left").join(ranks, "query_id", "left")
    r = r.withColumn("_rn", F.try_element_at("_ranks", F.col("ref"))).withColumn("_seen", F.array_contains("_bodies", F.col("ref")))
    gain = F.size(F.array_except(F.coalesce(F.try_element_at("_hits", F.col("ref")), none), F.coalesce(F.try_element_at("_hits", F.col("root")), none)))
    change = F.exists("route", lambda e: e["relation"].isin(*STATE_RELATIONS))
    was_seen = F.coalesce("_seen", F.lit(False))
    r = r.where((F.col("hop") == 0) | was_seen | F.col("chosen") | change | (gain > 0))
    place = F.struct((F.col("hop") > 0).alias("a"), (~change).alias("b"), (~was_seen).alias("c"), (-gain).alias("d"), F.col("hop").alias("e"), F.coalesce("_rn", F.lit(1 << 30)).alias("f"), F.col("ref").alias("g"), F.col("route").alias("route"))
    grouped = r.groupBy("query_id", "root", "root_rn").agg(F.array_sort(F.collect_list(place)).alias("_placed"))
    edges = F.array_distinct(F.flatten(F.transform("_placed", lambda p: p["route"])))
    ends = F.flatten(F.transform("edges", lambda e: F.array(e["src"], e["dst"])))
    return grouped.withColumn("edges", edges).select("query_id", "root", "root_rn", F.array_distinct(F.concat(F.array("root"), ends)).alias("members"), "edges")


def with_material(groups: DataFrame, nodes: DataFrame, fragments: DataFrame, page: int | None = None) -> DataFrame:
    """(query_id, groups, cards, fragments): one row a query, with its groups, the nodes they name, and each text that a member
    has or that a node or an edge cites, once for all groups. nodes: ref, kind, status, sources. fragments: origin, raw, start,
    end, length, text; ``length`` is that of the whole origin. With ``page``, fragments are whole texts (origin, raw, text), which
    each query cuts into pages where it shows them, so that pages are not moved."""
    g = groups.groupBy("query_id").agg(F.collect_list(F.struct("root_rn", "root", "members", "edges")).alias("groups"))
    refs = g.select("query_id", F.explode(F.array_distinct(F.flatten(F.col("groups.members")))).alias("ref"))
    known = F.struct("ref", "kind", "status", "sources")
    cards = refs.join(nodes.select("ref", "kind", "status", "sources"), "ref").groupBy("query_id").agg(F.collect_list(known).alias("cards"))
    g = g.join(cards, "query_id", "left")
    cited = F.concat(F.coalesce(F.flatten(F.col("cards.sources")), F.array().cast("array<string>")), F.flatten(F.flatten(F.transform("groups", lambda x: x["edges"]["sources"]))))
    named = lambda c, raw: F.transform(F.array_distinct(c), lambda o: F.struct(o.alias("origin"), F.lit(raw).alias("raw")))
    origins = g.select("query_id", F.explode(F.concat(named(F.flatten(F.col("groups.members")), False), named(cited, True))).alias("o")).select("query_id", "o.*")
    if page is None:
        piece = F.struct("start", "end", "length", "text")
        own = fragments.groupBy("origin", "raw").agg(F.collect_list(piece).alias("body"))
        cut = lambda t: F.transform(t["body"], lambda f: F.struct(t["origin"].alias("origin"), t["raw"].alias("raw"), f["start"].alias("start"), f["end"].alias("end"), f["length"].alias("length"), f["text"].alias("text")))
    else:
        own = fragments.select("origin", "raw", F.col("text").alias("body"))
        cut = lambda t: paged(t["origin"], t["body"], t["raw"], page)
    found = origins.join(own, ["origin", "raw"]).groupBy("query_id").agg(F.collect_list(F.struct("origin", "raw", "body")).alias("_texts"))
    return g.join(found, "query_id", "left").select("query_id", "groups", "cards", F.flatten(F.transform("_texts", cut)).alias("fragments"))


@dataclass
class Fragment:
    origin: str
    raw: bool
    start: int
    end: int
    length: int
    text: str

    @property
    def shown(self) -> str:
        return f"<{self.origin} {self.start}:{self.end}/{self.length}> {self.text}"

    def within(self, other: Fragment) -> bool:
        return self.origin == other.origin and other.start <= self.start and self.end <= other.end


@dataclass
class Group:
    root: str
    members: list[str]
    cards: list[tuple[str, str, str]]  # ref, kind, status
    edges: list[tuple[str, str, str, tuple[str, ...]]]  # src, dst, relation, sources
    sources: list[str]
    fragments: list[Fragment]
    taken: list[Fragment] = field(default_factory=list)
    reason: str = "top_k"
    chars: int = 0

    def header(self, edges: bool = True) -> list[str]:
        lines = [f"({kind}, {status}) {ref}" for ref, kind, status in self.cards]
        return lines + [f"{src} -{relation}-> {dst} by {', '.join(sources)}" for src, dst, relation, sources in (self.edges if edges else [])]

    def size(self, fragments: list[Fragment]) -> int:
        lines = [*map(len, self.header()), *(len(f.shown) for f in fragments)]
        return sum(lines) + max(0, len(lines) - 1)

    @property
    def closed(self) -> bool:
        """Whether both ends and all sources of every edge are among what is shown."""
        bodies = {f.origin for f in self.taken if not f.raw}
        cited = {f.origin for f in self.taken if f.raw}
        return all(src in bodies and dst in bodies and cited.issuperset(sources) for src, dst, _, sources in self.edges)

    def whole(self, origin: str) -> bool:
        """Whether the shown ranges cover the origin."""
        own = sorted((f.start, f.end, f.length) for f in self.taken if f.raw and f.origin == origin)
        reached = 0
        for start, end, _ in own:
            if start > reached:
                return False
            reached = max(reached, end)
        return bool(own) and reached >= own[0][2]


def distinct_groups(groups: list[Group]) -> Iterator[Group]:
    """Groups in rank order but those whose root an earlier one holds."""
    held: set[str] = set()
    for g in groups:
        if g.root not in held:
            held.update(g.members)
            yield g


def fill(groups: list[Group], top_k: int, card_chars: int, total_chars: int) -> list[Group]:
    """Decides what each group shows. First every group in turn reserves one fragment of each origin, within an even
    share of what is left; then what is still left goes to further fragments, in the same order."""
    left, chosen = total_chars, []
    for i, g in enumerate(groups):
        plain = not g.edges and g.fragments and all(kind == "episode" for _, kind, _ in g.cards)
        if plain and all(f.raw and any(f.within(p) for c in chosen for p in c.taken) for f in g.fragments):
            g.reason = "shown_before"
            continue
        if len(chosen) >= top_k:
            continue
        share = min(card_chars, left // max(1, min(top_k - len(chosen), len(groups) - i)))
        first: dict[str, Fragment] = {}
        for f in g.fragments:
            first.setdefault(f.origin, f)
        taken: list[Fragment] = []
        for f in first.values():
            if g.size([*taken, f]) <= share:
                taken.append(f)
        if not taken:
            g.reason = "no_room"
            continue
        g.taken, g.reason = taken, "packed"
        left -= g.size(taken)
        chosen.append(g)
    for g in chosen:
        for f in g.fragments:
            if any(f.within(t) for t in g.taken):
                continue
            more = g.size([*g.taken, f]) - g.size(g.taken)
            if g.size(g.taken) + more <= card_chars and more <= left:
                g.taken.append(f)
                left -= more
    return chosen


def card(g: Group, earlier: dict[tuple[str, int, int], str]) -> tuple[str, int]:
    """The group's text and how many fragments it shares: one that an earlier card has in full is named there, if that
    is shorter. Edges are shown only if they are closed."""
    lines, shared = g.header(g.closed), 0
    for f in g.taken:
        place = (f.origin, f.start, f.end)
        link = f"<{f.origin} {f.start}:{f.end} in {earlier[place]}>" if place in earlier else f.shown
        shared += len(link) < len(f.shown)
        lines.append(min(f.shown, link, key=len))
    return "\n".join(lines), shared


PACKED = (
    "query_id long, rn int, root string, members array<string>, reason string, n_fragments int, n_shared int, chars int, "
    "path_closed boolean, n_edges int, complete boolean, shown array<string>, content string"
)


def pack_groups(material: DataFrame, top_k: int = 10, card_chars: int = CARD_CHARS, total_chars: int = TOTAL_CHARS) -> DataFrame:
    """One row for each group of each query: its place among the cards (null if it is none, ``reason`` says why), what it
    shows, and whether its edges are closed, and its sources complete.

    material: the rows of ``with_material``. A query's groups are those of its roots, which the ranking leaves a few dozen of.
    """

    def pack(q: dict) -> Iterator[dict]:
        query_id, groups, pieces = q["query_id"], [], defaultdict(list)
        known = {c["ref"]: c for c in q["cards"] or ()}
        for f in sorted(q["fragments"] or (), key=lambda f: (f["start"], f["end"])):
            pieces[f["origin"], bool(f["raw"])].append(Fragment(f["origin"], bool(f["raw"]), f["start"], f["end"], f["length"], f["text"]))
        for r in sorted(q["groups"], key=lambda r: (r["root_rn"], r["root"])):
            edges = [(e["src"], e["dst"], e["relation"], tuple(e["sources"] or ())) for e in r["edges"]]
            nodes = [known.get(ref, {}) for ref in r["members"]]
            cards = [(ref, n.get("kind") or "unknown", n.get("status") or "active") for ref, n in zip(r["members"], nodes)]
            sources = list(dict.fromkeys([s for n in nodes for s in n.get("sources") or ()] + [s for e in edges for s in e[3]]))
            own = [f for ref in r["members"] for f in pieces[ref, False]] + [f for s in sources for f in pieces[s, True]]
            groups.append(Group(r["root"], r["members"], cards, edges, sources, own))
        groups = list(distinct_groups(groups))
        chosen, earlier = fill(groups, top_k, card_chars, total_chars), {}
        number = {id(g): i for i, g in enumerate(chosen, 1)}
        for g in groups:
            packed = id(g) in number
            content, shared = card(g, earlier) if packed else ("", 0)
            for f in g.taken:
                earlier.setdefault((f.origin, f.start, f.end), g.root)
            complete = packed and bool(g.sources) and all(map(g.whole, g.sources))
            shown = [f"{f.origin} {f.start}:{f.end}" for f in g.taken]
            row = (query_id, number.get(id(g)), g.root, g.members, g.reason, len(g.taken), shared, len(content), packed and g.closed, len(g.edges) if packed and g.closed else 0, complete, shown, content)
            yield dict(zip(names, row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_pylist([row for q in part for row in pack(q)], schema=schema)

    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PACKED.split(", ")])
    # A query is one row, so that a batch holds many queries: a Python group for each would cost more than its packing.
    return material.mapInArrow(run, PACKED)


def paged(origin: Column, text: Column, raw: Column, page: int = 800) -> Column:
    """An origin's text as adjacent fragments of at most ``page`` characters, for ``explode``."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(page))
    return F.transform(starts, lambda s: F.struct(origin.alias("origin"), raw.alias("raw"), s.cast("long").alias("start"), F.least(s + page, F.length(text)).cast("long").alias("end"), F.length(text).cast("long").alias("length"), F.substr(text, s + 1, F.lit(page)).alias("text")))
