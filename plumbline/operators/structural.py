"""Structural reports: cycles and the edges that cut them, islands, clone families, debt clusters, concentration."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import materialize, ship
from ..plans.sqlops import SqlOp
from ..plans.views import NOW, RELATIONS
from . import kernels as K
from .bridges import removals
from .findings import _DEBT, _SEVERITY

#: Literals that tell of side effects, of timers and retries, and of asynchronous branches, with the most that count of each.
SIDE_EFFECTS = ["setStore(", "dispatch(", ".dispatch(", "emit(", ".emit(", "invoke(", ".invoke(", "writeFile(", "readFile(", "spawn(", "exec(", "postMessage("]
TIMERS = ["setTimeout(", "setInterval(", "clearTimeout(", "clearInterval(", "retry(", ".retry(", "backoff(", ".backoff(", "debounce(", ".debounce(", "throttle(", ".throttle("]
ASYNC = ["await ", ".then(", ".catch(", ".finally(", "Promise.all(", "Promise.race(", "Promise.any(", "switch (", "try {"]
MOST_HITS = (3, 4, 6)
#: Comments and quoted text; a single or double quote that isn't closed ends with its line.
NOT_CODE = r"""//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?|`(?s:\\.|[^`\\])*`?"""
RECENT_DAYS, LEAST_CLONE_LINES, LEAST_SHARED_FILES = 30, 3, 2
SUPPORT = r"^(\.github|docs|examples|samples|fixtures|test|tests|testdata)/|/(examples|samples|fixtures|test|tests|testdata)/"


def _hits(patterns: list[str], most: int) -> str:
    return " + ".join(f"least({most}, IDIV(length(code) - length(replace(code, '{p}', '')), {len(p)}))" for p in patterns)


def scrub(contents: pd.Series) -> pd.Series:
    """Comments and quoted text as blanks of the same length; line feeds stay."""
    import re

    pattern = re.compile(NOT_CODE.replace(r"\z", r"\Z"))
    blank = re.compile(r"[^\n]")
    return contents.map(lambda s: None if s is None else pattern.sub(lambda m: blank.sub(" ", m[0]), s))


def scrub_code(contents: DataFrame) -> DataFrame:
    """(path, code) of (path, contents)."""
    ship(contents.sparkSession)
    return contents.select("path", F.pandas_udf(scrub, "string")("contents").alias("code"))


CODE_SQL = f"select path, regexp_replace(contents, '{NOT_CODE.replace(chr(39), chr(39) * 2)}', ' ', 'g') as code from @contents"


def cycles(edges: DataFrame) -> DataFrame:
    """(path, scc, size) of the files of components of more than one file."""
    s = K.scc(K.edges_of(edges))
    return s.join(s.groupBy("scc").agg(F.count("*").alias("size")).filter("size > 1"), "scc").select(F.col("node").alias("path"), "scc", "size")


_REACH = "reach(s, d) as (select from_file, to_file from @chain_edges union select r.s, e.to_file from reach r join @chain_edges e on e.from_file = r.d)"
CYCLES_SQL = f"with recursive {_REACH}, b as (select a.s, min(a.d) as scc from reach a join reach b on a.s = b.d and a.d = b.s group by a.s), z as (select scc, count(*) as size from b group by scc having count(*) > 1) select b.s as path, b.scc, z.size from b join z on z.scc = b.scc"


def cut_effects(cycles: DataFrame, candidates: DataFrame, others: DataFrame) -> DataFrame:
    """(scc, from_file, to_file, remaining, reduction) of each import edge within a cycle whose removal frees files of it.

    ``candidates`` are import edges, ``others`` call edges; the graph measured has both. All edges of a component are
    measured at once, in time nearly linear in them (see ``bridges``); a task holds one component's edges at a time.
    """
    ship(cycles.sparkSession)
    m = cycles.select("path", "scc")
    a, b = m.withColumnsRenamed({"path": "from_file", "scc": "x"}), m.withColumnsRenamed({"path": "to_file", "scc": "y"})
    marked = candidates.select("from_file", "to_file", F.lit(1).alias("c")).union(others.select("from_file", "to_file", F.lit(0).alias("c"))).groupBy("from_file", "to_file").agg(F.max("c").alias("c"))
    inner = marked.join(a, "from_file").join(b, "to_file").filter("x = y").select(F.col("x").alias("scc"), "from_file", "to_file", "c").repartition("scc").sortWithinPartitions("scc", "from_file", "to_file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def measured() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            codes, names = pd.factorize(pd.concat([rows["from_file"], rows["to_file"]]))
            remaining, reduction = removals(len(names), codes[: len(rows)], codes[len(rows) :])
            rows = rows.assign(remaining=remaining, reduction=reduction)
            return rows[(rows["c"] == 1) & (rows["reduction"] > 0)][["scc", "from_file", "to_file", "remaining", "reduction"]]

        for pdf in batches:
            for scc, part in pdf.groupby("scc", sort=False):
                if held and held[0]["scc"].iloc[0] != scc:
                    yield measured()
                    held = []
                held.append(part)
        if held:
            yield measured()

    return inner.mapInPandas(run, "scc string, from_file string, to_file string, remaining long, reduction long")


_INNER = "select distinct m.scc, e.from_file as s, e.to_file as d, max(e.c) as c from (select from_file, to_file, 1 as c from @chain_edges union all select from_file, to_file, 0 from @dag_edges) e join @cycles m on m.path = e.from_file join @cycles n on n.path = e.to_file and n.scc = m.scc group by 1, 2, 3"
EFFECTS_SQL = f"""
    with recursive ie as ({_INNER}), r(scc, es, ed, s, d) as (
        select c.scc, c.s, c.d, i.s, i.d from ie c join ie i on i.scc = c.scc and not (i.s = c.s and i.d = c.d) where c.c = 1
        union select r.scc, r.es, r.ed, r.s, i.d from r join ie i on i.scc = r.scc and i.s = r.d and not (i.s = r.es and i.d = r.ed)),
    k as (select a.scc, a.es, a.ed, a.s, count(distinct b.d) as n from r a join r b on b.scc = a.scc and b.es = a.es and b.ed = a.ed and b.s = a.s and a.d = a.s join r c on c.scc = a.scc and c.es = a.es and c.ed = a.ed and c.s = b.d and c.d = a.s group by 1, 2, 3, 4),
    t as (select scc, es, ed, count(*) as still, max(n) as remaining from k group by 1, 2, 3)
    select ie.scc, ie.s as from_file, ie.d as to_file, coalesce(t.remaining, 0) as remaining, z.size - coalesce(t.still, 0) as reduction
    from ie join (select distinct scc, size from @cycles) z on z.scc = ie.scc left join t on t.scc = ie.scc and t.es = ie.s and t.ed = ie.d where ie.c = 1 and z.size > coalesce(t.still, 0)"""

_CATEGORY = "case when STARTS({0}, 'src/') then split_part({0}, '/', 2) else split_part({0}, '/', 1) end"
_HINT = "MATCHES(lower({0}), 'contract|schema|types|state|model')"
_SEAM = f"case when coalesce(gs.guarded, 0) + coalesce(gt.guarded, 0) > 0 then case when ({_CATEGORY.format('e.from_file')} = 'app' and {_CATEGORY.format('e.to_file')} = 'store') or ({_CATEGORY.format('e.from_file')} = 'store' and {_CATEGORY.format('e.to_file')} = 'app') then 'guarded_app_store_boundary' else 'guarded_boundary_cut' end when coalesce(gs.facade, 0) + coalesce(gt.facade, 0) > 0 then 'facade_owner_boundary' when ({_CATEGORY.format('e.from_file')} = 'app' and {_CATEGORY.format('e.to_file')} = 'store') or ({_CATEGORY.format('e.from_file')} = 'store' and {_CATEGORY.format('e.to_file')} = 'app') then 'app_store_boundary' when {_HINT.format('e.from_file')} or {_HINT.format('e.to_file')} then 'contract_or_type_extraction' when {_CATEGORY.format('e.from_file')} <> {_CATEGORY.format('e.to_file')} then 'cross_layer_boundary' else 'local_module_split' end"
_CUTS = f"""
    with o as (select from_file, count(*) as n from @chain_edges group by from_file), i as (select to_file, count(*) as n from @chain_edges group by to_file),
    g as (select path, max(case when role = 'guarded_boundary' then 1 else 0 end) as guarded, max(case when role = 'facade_with_extracted_owners' then 1 else 0 end) as facade from @own_roles group by path),
    x as (select e.scc, e.from_file, e.to_file, e.remaining, e.reduction, c.size, {_SEAM} as seam, o.n as outs, i.n as ins
          from @cut_effects e join (select distinct scc, size from @cycles) c on c.scc = e.scc join o on o.from_file = e.from_file join i on i.to_file = e.to_file left join g gs on gs.path = e.from_file left join g gt on gt.path = e.to_file),
    y as (select *, cast(least(10000, 2000 + round(reduction / cast(size as double) * 4500) + case seam when 'guarded_app_store_boundary' then 2200 when 'guarded_boundary_cut' then 2000 when 'facade_owner_boundary' then 1900 when 'app_store_boundary' then 1800 when 'contract_or_type_extraction' then 1500 when 'cross_layer_boundary' then 1200 else 700 end + least(1800, (outs + ins) * 180) + least(1200, greatest(0, size - remaining) * 120)) as bigint) as score from x),
    r as (select *, row_number() over (partition by scc order by score desc, reduction desc, from_file, to_file) as place from y)
    select scc as cycle_id, place, from_file, to_file, seam, score, reduction, remaining from r where place <= 3"""
_BASIS = "select c.scc, count(case when e.c = 1 then 1 end) as imports, count(case when e.c = 0 then 1 end) as calls from (select distinct from_file, to_file, 1 as c from @chain_edges union all select distinct from_file, to_file, 0 from @dag_edges) e join @cycles c on c.path = e.from_file join @cycles d on d.path = e.to_file and d.scc = c.scc group by c.scc"
_CLUSTER = f"""
    with cuts as ({_CUTS}), best as (select * from cuts where place = 1), n as (select cycle_id, count(*) as cuts from cuts group by cycle_id), basis as ({_BASIS}),
    z as (select c.scc, max(c.size) as size, coalesce(sum(f.lines), 0) as lines, min(c.path) as first_file from @cycles c left join @files f on f.path = c.path group by c.scc),
    r as (select scc, sum(bonus) as roles from (select distinct c.scc, case t.role when 'component_barrel' then 1700 when 'guarded_boundary' then 1500 when 'composition_root' then 500 when 'entry_surface' then 400 end as bonus from @cycles c join @role_tags t on t.path = c.path) y group by scc),
    s as (select z.scc, z.size, z.lines, z.first_file, coalesce(n.cuts, 0) as cuts, coalesce(b.remaining, z.size) as remaining, case when q.calls > 0 and q.imports > 0 then 'mixed' when q.calls > 0 then 'interaction/call-only' else 'import-only' end as basis,
                 least(10000, 2400 + least(3200, z.size * 800) + least(1800, IDIV(z.lines, 14)) + least(2800, coalesce(r.roles, 0)) + case when b.cycle_id is null then 0 else case b.seam when 'guarded_app_store_boundary' then 1300 when 'guarded_boundary_cut' then 1100 when 'facade_owner_boundary' then 900 when 'app_store_boundary' then 700 when 'contract_or_type_extraction' then 600 when 'cross_layer_boundary' then 500 else 300 end + least(1100, b.reduction * 160) + round(b.reduction / cast(z.size as double) * 1500) + greatest(0, 700 - round(b.remaining / cast(z.size as double) * 700)) end) as base
          from z left join r on r.scc = z.scc left join best b on b.cycle_id = z.scc left join n on n.cycle_id = z.scc left join basis q on q.scc = z.scc),
    t as (select *, cast(case basis when 'import-only' then least(10000, base + 300) when 'mixed' then least(7800, greatest(0, base - 1200)) else least(4900, greatest(0, base - 2400)) end as bigint) as score from s)
    select scc as cycle_id, size, cast(lines as bigint) as lines, first_file, cuts, remaining as largest_after_best_cut, basis, score, {_SEVERITY.format('score')} as severity from t"""

_ROOTS = "select path from (select p.file as path from @entry_points p union select path from @files where is_barrel) r where exists (select 1 from @files f where f.path = r.path and not f.is_test)"
#: Where nothing marks a root: files that only tests depend on, with dependencies or public functions of their own.
_TOPS = "select f.path from @files f where not f.is_test and not exists (select 1 from @island_edges e join @files s on s.path = e.from_file where e.to_file = f.path and not s.is_test) and (exists (select 1 from @island_edges e where e.from_file = f.path) or exists (select 1 from @functions u where u.path = f.path and u.is_public))"
APP_ROOTS = f"with r as ({_ROOTS}), t as ({_TOPS}) select path from r union select path from t where not exists (select 1 from r)"


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path) that seeds (path) reach, themselves too."""
    return K.bfs(K.edges_of(edges), seeds.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))


def islands(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, island): undirected components over all edges, files without edges too."""
    linked = K.connected(K.edges_of(edges)).select(F.col("node").alias("path"), F.col("component").alias("island"))
    return materialize(linked.union(files.select("path").join(linked, "path", "left_anti").select("path", F.col("path").alias("island"))))


_FORWARD = "with recursive r(path) as (select path from {0} union select e.to_file from r join @island_edges e on e.from_file = r.path) select path from r"
_ISLANDS_SQL = "with recursive b as (select from_file as s, to_file as d from @island_edges union select to_file, from_file from @island_edges), r(s, d) as (select path, path from @files union select r.s, b.d from r join b on b.s = r.d) select s as path, min(d) as island from r group by s"
_ISLAND_CYCLES = "select s.path, s.scc, z.n from @island_sccs s join (select scc, count(*) as n from @island_sccs group by scc having count(*) > 1) z on z.scc = s.scc"
_DEAD_ISLAND = f"""
    with m as (select i.island, i.path, coalesce(f.lines, 0) as lines, coalesce(f.is_test, false) as is_test, case when a.path is null then 0 else 1 end as app, case when t.path is null then 0 else 1 end as tested, coalesce(u.n, 0) as public_ones,
                      case when f.is_barrel then 1 else 0 end as surface, case when MATCHES(lower(i.path), '{SUPPORT}') then 1 else 0 end as support, coalesce(c.n, 0) as cycle
               from @islands i left join @files f on f.path = i.path left join @app_reach a on a.path = i.path left join @test_reach t on t.path = i.path
               left join (select path, count(*) as n from @functions where is_public group by path) u on u.path = i.path left join ({_ISLAND_CYCLES}) c on c.path = i.path),
    g as (select island, count(*) as files, sum(lines) as lines, max(cycle) as cycle, max(tested) as tested, max(app) as app, sum(public_ones) as public_ones, max(surface) as surface, min(support) as support, max(case when is_test then 0 else 1 end) as sources from m group by island),
    s as (select *, cast(greatest(0, 2800 + least(3600, files * 900) + least(2600, IDIV(lines, 10)) + least(2100, cycle * 700) - case when tested = 1 then 1200 else 0 end) as bigint) as score from g where sources = 1 and app = 0 and support = 0 and public_ones = 0 and surface = 0 and (files >= 2 or cycle >= 2) and (select count(*) from @app_roots) > 0)
    select island, files, cast(lines as bigint) as lines, cast(cycle as bigint) as cycle, tested = 1 as reachable_from_tests, score, {_SEVERITY.format('score')} as severity from s"""

_HISTORY = f"select path, count(*) as commits, max(epoch) as last_epoch, greatest(0, IDIV({NOW} - max(epoch), 86400)) as age_days from (select f.path, c.epoch from @commit_files f join @commits c on c.commit_id = f.commit_id) h group by path"
#: Groups of equal bodies in two files or more, at least one of them production code, with the activity of their files.
_CLONES = f"""
    with h as ({_HISTORY}), i as (select f.bh, f.path, f.ln, f.is_test from @functions f where f.bh is not null and f.bh <> 0),
    n as (select bh, count(*) as instances, sum(case when is_test then 0 else 1 end) as production, max(ln) as longest, cast(sum(ln) as bigint) as total_lines from i group by bh),
    d as (select i.bh, i.path, max(h.commits) as commits, max(h.age_days) as age_days, max(h.last_epoch) as last_epoch from i left join h on h.path = i.path group by i.bh, i.path),
    a as (select bh, count(*) as files, coalesce(max(commits), 0) as commits, sum(case when age_days <= {RECENT_DAYS} then 1 else 0 end) as recent, sum(case when coalesce(commits, 0) > 0 or age_days <= {RECENT_DAYS} then 1 else 0 end) as active from d group by bh)
    select n.bh, n.instances, cast(n.production as bigint) as production, n.longest, n.total_lines, a.files, a.commits, cast(a.recent as bigint) as recent, a.active > 0 and a.active < a.files as asymmetric,
           cast(n.instances * n.longest + 4 * a.commits + 3 * a.recent + case when a.active > 0 and a.active < a.files then 12 else 0 end as bigint) as risk,
           case when n.longest >= 20 or (n.production >= 2 and n.longest >= 10 and ((a.active > 0 and a.active < a.files) or a.commits >= 3)) or (n.instances >= 3 and n.longest >= 8) then 'high'
                when n.longest >= 8 or (a.active > 0 and a.active < a.files and a.commits >= 1) or (n.instances >= 3 and n.longest >= 5) then 'medium' else 'low' end as severity
    from n join a on a.bh = n.bh where a.files > 1 and n.production >= 1 and n.longest >= {LEAST_CLONE_LINES}"""
_CLONE_LINKS = f"select a.bh as a, b.bh as b from (select distinct f.bh, f.path from @functions f join @clones c on c.bh = f.bh) a join (select distinct f.bh, f.path from @functions f join @clones c on c.bh = f.bh) b on a.path = b.path and a.bh < b.bh group by a.bh, b.bh having count(*) >= {LEAST_SHARED_FILES}"


def clone_families(links: DataFrame) -> DataFrame:
    """(bh, family) of groups that are linked, by the smallest group of their component."""
    e = materialize(links.select(F.lpad(F.col("a").cast("string"), 20, "0").alias("src"), F.lpad(F.col("b").cast("string"), 20, "0").alias("dst")))
    return K.connected(e).select(F.col("node").cast("long").alias("bh"), F.col("component").cast("long").alias("family"))


_FAMILIES_SQL = f"with recursive l as ({_CLONE_LINKS}), b as (select a as s, b as d from l union select b, a from l), r(s, d) as (select s, s from b union select r.s, b.d from r join b on b.s = r.d) select s as bh, min(d) as family from r group by s"
_RANK = "case severity when 'high' then 3 when 'medium' then 2 else 1 end"
_DIVERGENCE = f"""
    with h as ({_HISTORY}), m as (select distinct c.family, f.bh, f.path from @clone_families c join @functions f on f.bh = c.bh),
    sets as (select family, bh, SETJOIN(path) as files from m group by family, bh), d as (select family, count(distinct files) as file_sets, count(*) as members from sets group by family),
    p as (select distinct family, path from m), a as (select p.family, count(*) as files, sum(case when h.age_days <= {RECENT_DAYS} then 1 else 0 end) as recent, sum(case when coalesce(h.commits, 0) > 0 or h.age_days <= {RECENT_DAYS} then 1 else 0 end) as active, max(h.commits) - min(h.commits) as commit_gap, IDIV(max(h.last_epoch) - min(h.last_epoch), 86400) as age_gap from p left join h on h.path = p.path group by p.family)
    select a.family, d.members, a.files, d.file_sets, cast(a.recent as bigint) as recent, a.active > 0 and a.active < a.files as asymmetric, a.commit_gap, cast(a.age_gap as bigint) as age_gap,
           cast(least(44, case when a.active > 0 and a.active < a.files then 18 else 0 end + case when d.file_sets > 1 then 8 else 0 end + case when a.commit_gap is null or a.commit_gap <= 1 then 0 when a.commit_gap <= 3 then 6 when a.commit_gap <= 7 then 10 else 14 end + case when a.age_gap is null or a.age_gap <= 7 then 0 when a.age_gap <= 29 then 4 when a.age_gap <= 59 then 8 else 12 end + 2 * least(3, a.recent)) as bigint) as divergence
    from a join d on d.family = a.family"""
_FAMILY = f"""
    with v as ({_DIVERGENCE}), r as (select c.family, k.bh, k.severity, k.risk, row_number() over (partition by c.family order by case k.severity when 'high' then 3 when 'medium' then 2 else 1 end desc, k.risk desc, k.bh) as place from @clone_families c join @clones k on k.bh = c.bh)
    select v.family, r.bh as representative, r.severity, v.members, v.files, v.file_sets, v.divergence, cast(r.risk + 4 * least(3, v.members - 1) + v.divergence as bigint) as family_score from v join r on r.family = v.family and r.place = 1"""

#: Signals with each file they name: structural debt, and cycles.
_SIGNALS = f"select kind || ':' || scope as signal, kind, score, scope as file from ({_DEBT}) d union all select 'cycle_cluster:' || c.cycle_id, 'cycle_cluster', c.score, m.path from @cycle_clusters c join @cycles m on m.scc = c.cycle_id"


def debt_components(signals: DataFrame) -> DataFrame:
    """(signal, cluster): signals that share files, directly or by others, over a graph of signals and files."""
    e = materialize(signals.select(F.concat(F.lit("s "), "signal").alias("src"), F.concat(F.lit("f "), "file").alias("dst")).distinct())
    found = K.connected(e)
    own = found.filter(F.col("node").startswith("s ")).select(F.substring("node", 3, 1_000_000).alias("signal"), "component")
    return own.join(own.groupBy("component").agg(F.min("signal").alias("cluster")), "component").select("signal", "cluster")


_CLUSTERS_SQL = "with recursive b as (select distinct a.signal as s, b.signal as d from @debt_signal_files a join @debt_signal_files b on a.file = b.file), r(s, d) as (select s, s from b union select r.s, b.d from r join b on b.s = r.d) select s as signal, min(d) as cluster from r group by s"
_DEBT_CLUSTERS = f"""
    with s as (select distinct signal, kind, score from @debt_signal_files), g as (select c.cluster, count(*) as signals, SETJOIN(s.kind) as kinds, max(s.score) as top from @debt_components c join s on s.signal = c.signal group by c.cluster having count(*) >= 2),
    f as (select c.cluster, count(distinct x.file) as files from @debt_components c join @debt_signal_files x on x.signal = c.signal group by c.cluster),
    t as (select g.*, f.files, cast(least(10000, g.top + least(2000, (g.signals - 1) * 500)) as bigint) as score from g join f on f.cluster = g.cluster)
    select cluster, signals, kinds, files, score, {_SEVERITY.format('score')} as severity from t"""

_CONCENTRATION = f"""
    with p as (select path, {_hits(SIDE_EFFECTS, MOST_HITS[0])} as effects, {_hits(TIMERS, MOST_HITS[1])} as timers, {_hits(ASYNC, MOST_HITS[2])} as branches from @code),
    cc as (select path, max(cc) as cc from @functions group by path), ch as (select path, count(*) as commits from @commit_files group by path),
    w as (select path, count(distinct symbol) as symbols from @writes group by path), a as (select w.path, count(distinct t.concept) as concepts from @writes w join @concept_targets t on t.target = w.symbol group by w.path),
    v as (select p.path, coalesce(a.concepts, 0) as authority, p.effects + coalesce(w.symbols, 0) as effects, p.timers, p.branches, coalesce(cc.cc, 0) as cc, coalesce(ch.commits, 0) as commits, ch.path is not null as history
          from p left join cc on cc.path = p.path left join ch on ch.path = p.path left join w on w.path = p.path left join a on a.path = p.path),
    s as (select *, least(1.0, authority / cast(3 as double)) * 0.22 + least(1.0, effects / cast(12 as double)) * 0.20 + least(1.0, timers / cast(8 as double)) * 0.16 + least(1.0, branches / cast(12 as double)) * 0.14 + least(1.0, cc / cast(25 as double)) * 0.14 as fixed,
                 greatest(least(1.0, commits / cast(20 as double)), least(1.0, commits * greatest(cc, 1) / cast(250 as double))) * 0.14 as moving from v)
    select path, cast(authority as bigint) as authority_breadth, cast(effects as bigint) as side_effect_breadth, cast(timers as bigint) as timer_retry_weight, cast(branches as bigint) as async_branch_weight, cast(cc as bigint) as max_complexity, commits as churn_commits,
           cast(round(round(case when history then fixed + moving else fixed / 0.86 end, 9) * 10000) as bigint) as score from s"""

RELATIONS.computed |= {
    "code": (scrub_code, ("contents",), CODE_SQL),
    "cycles": (lambda e: materialize(cycles(e)), ("chain_edges",), CYCLES_SQL),
    "cut_effects": (lambda c, i, o: materialize(cut_effects(c, i, o)), ("cycles", "chain_edges", "dag_edges"), EFFECTS_SQL),
    "island_sccs": (lambda e: K.scc(K.edges_of(e)).select(F.col("node").alias("path"), "scc"), ("island_edges",), "with recursive reach(s, d) as (select from_file, to_file from @island_edges union select r.s, e.to_file from reach r join @island_edges e on e.from_file = r.d), nodes as (select from_file as node from @island_edges union select to_file from @island_edges) select n.node as path, least(n.node, coalesce(min(r.d), n.node)) as scc from nodes n left join (select a.s, a.d from reach a join reach b on a.s = b.d and a.d = b.s) r on r.s = n.node group by n.node"),
    "app_reach": (reach, ("island_edges", "app_roots"), _FORWARD.format("@app_roots")),
    "test_reach": (lambda e, f: reach(e, f.filter("is_test")), ("island_edges", "files"), _FORWARD.format("@files where is_test")),
    "islands": (islands, ("island_edges", "files"), _ISLANDS_SQL),
    "clone_families": (lambda f, c: materialize(clone_families(SqlOp("links", _CLONE_LINKS).run(functions=f, clones=c))), ("functions", "clones"), _FAMILIES_SQL),
    "debt_components": (debt_components, ("debt_signal_files",), _CLUSTERS_SQL),
}
RELATIONS.views |= {"app_roots": APP_ROOTS, "clones": _CLONES, "cycle_clusters": _CLUSTER, "dead_islands": _DEAD_ISLAND, "debt_signal_files": _SIGNALS}

OPS: dict[str, SqlOp] = {
    "cycle_cut_candidates": SqlOp("The three best edges of each cycle by which to cut it", _CUTS),
    "cycle_cluster": SqlOp("Each cycle's files, size, lines, edge basis, cuts and score", f"select k.*, m.files from ({_CLUSTER}) k join (select scc, SETJOIN(path) as files from @cycles group by scc) m on m.scc = k.cycle_id"),
    "cycle_edge_basis": SqlOp("Import and call edges within each cycle", f"select scc as cycle_id, imports, calls, case when imports > 0 and calls > 0 then 'mixed' when calls > 0 then 'interaction/call-only' else 'import-only' end as basis from ({_BASIS}) b"),
    "app_roots": SqlOp("Entry points, entry surfaces and barrels that are no tests; without any, tops of the graph", APP_ROOTS),
    "dead_island": SqlOp("Components that no application root reaches and nothing public opens, with a score", _DEAD_ISLAND),
    "exact_clone_groups": SqlOp("Groups of equal bodies across files, with risk and severity", _CLONES),
    "clone_drift": SqlOp("Clone groups by risk", f"select bh as group_no, instances as n, files, longest, risk, severity from ({_CLONES}) c"),
    "clone_families": SqlOp("Groups that share at least two files, as families", "select bh, family from @clone_families"),
    "clone_divergence": SqlOp("How far the files of a family have drifted apart", _DIVERGENCE),
    "clone_family_summary": SqlOp("Families with their first group and score", _FAMILY),
    "clone_order": SqlOp("Clone groups by severity, risk and number", f"select bh, row_number() over (partition by severity order by risk desc, bh) as place_in_severity, {_RANK} as severity_rank from @clones"),
    "debt_clusters": SqlOp("Signals that share files, two or more, with a score", _DEBT_CLUSTERS),
    "concentration": SqlOp("Six normalised weights of coordination in one score", _CONCENTRATION),
    "pattern_hits": SqlOp("Literals of three kinds in code, each counted up to a limit", f"select path, cast({_hits(SIDE_EFFECTS, MOST_HITS[0])} as bigint) as side_effects, cast({_hits(TIMERS, MOST_HITS[1])} as bigint) as timers, cast({_hits(ASYNC, MOST_HITS[2])} as bigint) as branches from @code"),
    "scrub_code": SqlOp("Sources without comments and quoted text, white space aside", "select path, replace(replace(code, ' ', ''), chr(10), '') as code from @code"),
}
