"""Structural analytics over a property graph: joins and aggregates that leave the plan to the optimizer.

Rows whose path is null take part where no path is needed and are left out of figures by file; null names and decorators are
empty; divisions by nothing give 0; an empty graph gives empty results. Extra columns of the inputs are never read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import traverse
from graphloom.schema import CALL_KINDS

FUNCTIONS = ("function", "method")

# Paths of test files, in the regular expressions both engines read.
TEST_FILE = r"(^|/)(test|tests|spec)/|(^|/)test_[^/]*$|_test\.(py|go)$|(^|/)[^/]*Test[^/]*\.(java|kt|scala)$|\.(test|spec)\.(ts|tsx|js|jsx)$"
# Names and decorators by which entry points are told.
CLI_DECORATORS = "typer|click|argparse|commander"
ROUTE_DECORATORS = r"route\(|\.get\(|\.post\(|\.put\(|\.delete\(|\.patch\(|\.head\(|\.options\("
INIT_NAMES = ("__init__", "constructor", "init")
HOOK_NAMES = tuple(
    "useEffect useLayoutEffect useState useReducer useContext useRef useMemo useCallback componentDidMount componentDidUpdate componentWillUnmount shouldComponentUpdate getDerivedStateFromProps getSnapshotBeforeUpdate "
    "ngOnInit ngOnDestroy ngOnChanges ngDoCheck ngAfterContentInit ngAfterContentChecked ngAfterViewInit ngAfterViewChecked mounted created beforeMount beforeCreate beforeDestroy destroyed updated beforeUpdate activated deactivated".split()
)
# Endings of names that bring data in, and of those that let it do harm.
TAINT_SOURCES = (
    "os::environ", "os::environ::get", "os::getenv", "input", "open", "pathlib::Path::read_text", "pathlib::Path::read_bytes", "json::load", "json::loads", "tomllib::load", "configparser::ConfigParser::read",
    "requests::Response::json", "requests::get", "requests::post", "flask::request::get_json", "flask::request::args", "django::http::HttpRequest::GET", "django::http::HttpRequest::POST",
    "process::env", "fetch", "window::fetch", "fs::readFileSync", "fs::readFile", "document::getElementById", "express::req::body", "express::req::query", "express::req::params",
    "read", "readline", "readlines", "sys::stdin::read", "sys::stdin::readline",
)
TAINT_SINKS = (
    "os::system", "os::popen", "os::execv", "os::execve", "subprocess::run", "subprocess::call", "subprocess::Popen", "subprocess::check_output", "subprocess::check_call", "eval", "exec", "compile",
    "execute", "executemany", "executescript", "cursor::execute", "Cursor::execute", "connection::execute", "Connection::execute", "open", "write", "writelines",
    "requests::post", "requests::put", "requests::patch", "httpx::post", "httpx::Client::post", "smtplib::SMTP::sendmail", "child_process::exec", "child_process::execSync", "child_process::spawn", "child_process::fork",
    "eval", "Function", "document::write", "innerHTML", "fetch", "XMLHttpRequest::send", "query", "connection::query", "pool::query", "fs::writeFileSync", "fs::writeFile", "send",
)


def is_test(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_FILE), F.lit(False))


def functions(graph: PropertyGraph, *cols: str) -> DataFrame:
    return graph.nodes("kind", *cols).filter(F.col("kind").isin(*FUNCTIONS))


# --- entry points and dead code ---


def entry_points(graph: PropertyGraph) -> DataFrame:
    """id, file_path, entry_type, confidence: the first rule that fits each function or method holds."""
    f = functions(graph, "name", "qualified_name", "file_path", "decorators")
    name, path, deco = F.coalesce("name", F.lit("")), F.lower(F.coalesce("file_path", F.lit(""))), F.coalesce("decorators", F.lit(""))
    rules = [
        (F.contains(F.coalesce("qualified_name", F.lit("")), F.lit("__main__")) | (name == "main"), "main", 0.9),
        (F.startswith(name, F.lit("test_")), "test", 0.9),
        (path.rlike("test|spec"), "test", 0.7),
        (F.contains(deco, F.lit("Test")), "test", 0.8),
        (F.lower(deco).rlike(CLI_DECORATORS), "cli", 0.8),
        (F.lower(deco).rlike(ROUTE_DECORATORS), "route_handler", 0.8),
        (name.isin(*INIT_NAMES), "init", 0.9),
        (name.isin(*HOOK_NAMES), "hook", 0.9),
    ]
    rule = reduce(lambda w, r: w.when(r[0], F.struct(F.lit(r[1]).alias("t"), F.lit(r[2]).alias("c"))), rules[1:], F.when(rules[0][0], F.struct(F.lit("main").alias("t"), F.lit(0.9).alias("c"))))
    return f.withColumn("r", rule).filter("r is not null").select("id", "file_path", F.col("r.t").alias("entry_type"), F.col("r.c").alias("confidence"))


def one_entry_a_file(entries: DataFrame) -> DataFrame:
    """The smallest id of each file and type."""
    return entries.groupBy("file_path", "entry_type").agg(F.min_by(F.struct("id", "confidence"), "id").alias("r")).select("file_path", "entry_type", "r.id", "r.confidence")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with in_degree and out_degree over ``edges``."""
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.join(into, "id", "left").join(out, "id", "left").fillna(0, ["in_degree", "out_degree"])


def dead_by_degree(graph: PropertyGraph) -> DataFrame:
    """Functions and methods nobody calls or references that are no entry point, with their degrees."""
    e = graph.edges("id", kinds=["calls", "references"])
    d = degrees(e, functions(graph, "name").drop("kind"))
    return d.filter("in_degree = 0").join(entry_points(graph).select("id"), "id", "left_anti")


def dead_by_rules(graph: PropertyGraph) -> DataFrame:
    """Nodes of any kind nobody calls or references, but for tests, mains, handlers, hooks, exports, dunders and declarations."""
    n = graph.nodes("name", "kind", "file_path", "is_exported")
    low, name, path = F.lower(F.coalesce("name", F.lit(""))), F.coalesce("name", F.lit("")), F.coalesce("file_path", F.lit(""))
    spared = (
        F.contains(path, F.lit("test")) | path.endswith("__init__.py") | (low == "main") | (F.contains(low, F.lit("main")) & (F.col("kind") == "function"))
        | low.startswith("handle_") | low.endswith("_handler") | low.endswith("_route") | low.endswith("_endpoint") | low.isin("startup", "shutdown", "init")
        | (F.coalesce("is_exported", F.lit(0)) == 1) | (name.startswith("__") & name.endswith("__")) | name.startswith("test_") | name.endswith("_test")
        | F.col("kind").isin("variable", "constant", "html_element", "css_rule", "md_heading", "md_link")
    )
    called = graph.edges(kinds=["calls", "references"]).select(F.col("target").alias("id")).filter("id is not null").distinct()
    return n.filter(~spared).join(called, "id", "left_anti").select("id", "name", "kind", "file_path")


def dead_by_reach(graph: PropertyGraph) -> DataFrame:
    """id, reason: production functions no entry point reaches over calls. Too few entries (under 5 and under 1 % of the functions): those nobody calls that call others count too."""
    f = functions(graph, "file_path").filter(~is_test(F.col("file_path"))).select("id")
    calls = graph.edges(kinds=["calls"]).select("source", "target").filter("target is not null").distinct()
    d = degrees(calls, f)
    entries = entry_points(graph).select("id").join(f, "id", "left_semi")
    if entries.count() < max(5, f.count() / 100):
        entries = entries.unionByName(d.filter("in_degree = 0 and out_degree > 0").select("id")).distinct()
    live = traverse.reachable(calls, entries)
    reason = F.when(F.col("out_degree") > 0, "unreachable").when(F.col("in_degree") > 0, "unreachable_from_entry").otherwise("no_callers")
    return d.join(live, "id", "left_anti").select("id", reason.alias("reason"))


# --- layers, metrics, health ---


def layer_violations(graph: PropertyGraph, layer: Column) -> DataFrame:
    """source, target, source_layer, target_layer of calls across files from a higher number to a lower; ``layer`` is a column over file_path."""
    n = graph.nodes("file_path").filter("file_path is not null").select("id", "file_path", layer.alias("layer")).filter("layer is not null")
    e = graph.links("calls")
    s = n.select(F.col("id").alias("source"), F.col("file_path").alias("f1"), F.col("layer").alias("source_layer"))
    t = n.select(F.col("id").alias("target"), F.col("file_path").alias("f2"), F.col("layer").alias("target_layer"))
    return e.join(s, "source").join(t, "target").filter("f1 <> f2 and source_layer > target_layer").select("source", "target", "source_layer", "target_layer")


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """path, level of the longest of ``prefixes`` (prefix, level) that is a leading part of the path; joined on each part, so equalities do."""
    parts = paths.select("path", F.split("path", "/").alias("p")).distinct()
    parts = parts.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.concat_ws("/", F.slice("p", F.lit(1), k)))).alias("prefix"))
    return parts.join(prefixes, "prefix").groupBy("path").agg(F.max_by("level", F.length("prefix")).alias("level"))


def layer_violations_prefix(graph: PropertyGraph, prefixes: DataFrame) -> DataFrame:
    """source, target of imports and calls from a lower level to a higher, levels by longest prefix of the file's path."""
    n = graph.nodes("file_path").filter("file_path is not null")
    level = n.join(longest_prefix(n.select(F.col("file_path").alias("path")), prefixes), F.col("file_path") == F.col("path")).select("id", "level")
    e = graph.links("calls", "imports").join(level.select(F.col("id").alias("source"), F.col("level").alias("source_level")), "source")
    return e.join(level.select(F.col("id").alias("target"), F.col("level").alias("target_level")), "target").filter("source_level < target_level")


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b != 0, a / b).otherwise(0.0), 6)


def unit_metrics(graph: PropertyGraph, unit: Column, kinds: tuple[str, ...] = (), count_units: bool = False) -> DataFrame:
    """unit, internal, outgoing, incoming, cohesion, coupling, instability; ``count_units``: coupling counts other units, not links."""
    n = graph.nodes("file_path").filter("file_path is not null").select("id", unit.alias("unit"))
    e = graph.links(*kinds).join(n.select(F.col("id").alias("source"), F.col("unit").alias("a")), "source").join(n.select(F.col("id").alias("target"), F.col("unit").alias("b")), "target")
    inner = F.when(F.col("a") == F.col("b"), 1)
    other = F.when(F.col("a") != F.col("b"), F.col("b"))
    mine = e.groupBy(F.col("a").alias("unit")).agg(F.count(inner).alias("internal"), F.count(other).alias("outgoing"), F.countDistinct(other).alias("ce"))
    theirs = e.filter("a <> b").groupBy(F.col("b").alias("unit")).agg(F.count("*").alias("incoming"), F.countDistinct("a").alias("ca"))
    m = mine.join(theirs, "unit", "full_outer").fillna(0)
    ca, ce = (F.col("ca"), F.col("ce")) if count_units else (F.col("incoming"), F.col("outgoing"))
    return m.select(
        "unit", "internal", "outgoing", "incoming", _ratio(F.col("internal"), F.col("internal") + F.col("outgoing")).alias("cohesion"), (ca + ce).alias("coupling"), _ratio(ce, ca + ce).alias("instability")
    )


def health(graph: PropertyGraph) -> DataFrame:
    """file_path, score, functions, tested, dead, dependencies: 40 % tested, 25 % called outside tests, 20 % few dependencies, 15 % few functions; production files."""
    f = functions(graph, "file_path").filter("file_path is not null").select("id", "file_path", is_test(F.col("file_path")).alias("test"))
    prod = f.filter("not test").select("id", "file_path")
    calls = graph.links("calls")
    by = calls.join(f.select(F.col("id").alias("source"), "test"), "source")
    tested = by.filter("test").select(F.col("target").alias("id")).distinct().withColumn("tested", F.lit(1))
    n = graph.nodes("file_path")
    callers = calls.join(n.select(F.col("id").alias("source"), is_test(F.col("file_path")).alias("t")), "source").filter("not t")
    called = callers.select(F.col("target").alias("id")).distinct().withColumn("called", F.lit(1))
    deps = (
        graph.links("calls", "imports").join(prod.select(F.col("id").alias("source"), F.col("file_path").alias("f1")), "source")
        .join(n.select(F.col("id").alias("target"), F.col("file_path").alias("f2")), "target").filter("f1 <> f2 and f2 not like 'tests/%'")
        .groupBy(F.col("f1").alias("file_path")).agg(F.countDistinct("target").alias("dependencies"))
    )
    per = prod.join(tested, "id", "left").join(called, "id", "left").groupBy("file_path").agg(
        F.count("*").alias("functions"), F.count("tested").alias("tested"), F.sum(F.when(F.col("called").isNull(), 1).otherwise(0)).alias("dead")
    )
    per = per.join(deps, "file_path", "left").fillna(0, ["dependencies"])
    top = per.agg(F.max("functions").alias("f"), F.max("dependencies").alias("d")).first()
    fmax, dmax = max(top.f or 0, 1), max(top.d or 0, 1)
    score = (
        F.col("tested") / F.col("functions") * 100 * 0.40 + (F.col("functions") - F.col("dead")) / F.col("functions") * 100 * 0.25
        + (100 - F.col("dependencies") / dmax * 100) * 0.20 + (100 - F.col("functions") / fmax * 100) * 0.15
    )
    return per.select("file_path", F.floor(F.round(score, 6)).alias("score"), "functions", "tested", "dead", "dependencies")


def health_by_links(graph: PropertyGraph) -> DataFrame:
    """file_path, score, coupling, dead_ratio: 35 % a test file names it, 25 % small, 25 % links within the file, 15 % no dead nodes."""
    n = graph.nodes("file_path", "kind").filter("file_path is not null")
    e = graph.links().join(n.select(F.col("id").alias("source"), F.col("file_path").alias("f1")), "source").join(n.select(F.col("id").alias("target"), F.col("file_path").alias("f2")), "target")
    links = e.groupBy(F.col("f1").alias("file_path")).agg(F.avg((F.col("f1") != F.col("f2")).cast("double")).alias("coupling"))
    dead = dead_by_rules(graph).select("id", F.lit(1).alias("dead"))
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "")
    files = n.select("file_path", stem.alias("stem")).distinct()
    tested = files.filter("stem like '%test%'").select(F.explode(F.array(F.regexp_replace("stem", "^test_|_?[tT]est$", ""), F.col("stem"))).alias("stem")).distinct().withColumn("covered", F.lit(1.0))
    per = n.join(dead, "id", "left").groupBy("file_path").agg(F.count("*").alias("nodes"), F.count("dead").alias("dead"))
    per = per.join(files.join(tested, "stem", "left").select("file_path", "covered"), "file_path").join(links, "file_path", "left").fillna(0.0, ["covered", "coupling"])
    ratio = F.col("dead") / F.col("nodes")
    score = 0.35 * F.col("covered") + 0.25 * (1 - F.least(F.col("nodes") / 50, F.lit(1.0))) + 0.25 * (1 - F.col("coupling")) + 0.15 * (1 - ratio)
    return per.select("file_path", F.round(score, 6).alias("score"), "covered", F.round("coupling", 6).alias("coupling"), F.round(ratio, 6).alias("dead_ratio"))


# --- tests ---


def coverage(graph: PropertyGraph) -> DataFrame:
    """file_path, functions, covered, percent: production functions that test functions call."""
    f = functions(graph, "file_path").filter("file_path is not null").withColumn("test", is_test(F.col("file_path")))
    hit = graph.links("calls").join(f.filter("test").select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"), F.lit(1).alias("hit")).distinct()
    per = f.filter("not test").join(hit, "id", "left").groupBy("file_path").agg(F.count("*").alias("functions"), F.count("hit").alias("covered"))
    return per.withColumn("percent", F.round(F.col("covered") / F.col("functions") * 100, 4))


def _best(links: list[DataFrame]) -> DataFrame:
    every = reduce(lambda a, b: a.unionByName(b), links)
    return every.groupBy("test_id", "source_id").agg(F.max(F.struct("confidence", "derivation")).alias("r")).select("test_id", "source_id", "r.confidence", "r.derivation")


def _base(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def test_links(graph: PropertyGraph, strict: bool = True) -> DataFrame:
    """test_id, source_id, confidence, derivation: what a test function is about. Strict: names count where the files' names fit too
    (0.9), calls 0.8, imports 0.5; else names alone 0.9, imports 0.8, calls 0.5. The best of a pair holds."""
    f = functions(graph, "name", "file_path").filter("file_path is not null and name is not null")
    test = f.filter(is_test(F.col("file_path"))).select(F.col("id").alias("test_id"), F.regexp_replace("name", "^[tT]est_?|_?[tT]est$", "").alias("about"), F.regexp_replace(_base(F.col("file_path")), "^test_|_test$|Test$", "").alias("file"))
    prod = f.filter(~is_test(F.col("file_path"))).select(F.col("id").alias("source_id"), F.col("name").alias("about"), _base(F.col("file_path")).alias("file"))
    by_name = test.filter("about <> ''").join(prod, ["about", "file"] if strict else ["about"])
    made = [by_name.select("test_id", "source_id", F.lit(0.9).alias("confidence"), F.lit("naming").alias("derivation"))]
    for kind, conf in (("calls", 0.8 if strict else 0.5), ("imports", 0.5 if strict else 0.8)):
        e = graph.links(kind).select(F.col("source").alias("test_id"), F.col("target").alias("source_id"))
        made.append(e.join(test, "test_id", "left_semi").join(prod, "source_id", "left_semi").select("test_id", "source_id", F.lit(conf).alias("confidence"), F.lit(kind).alias("derivation")))
    return _best(made)


# --- change ---


def impact_prediction(graph: PropertyGraph, seeds: DataFrame) -> DataFrame:
    """seed, direct, indirect, files, fan_out, risk of changing each seed: what calls, references or imports it within three steps."""
    links = graph.links(*CALL_KINDS)
    met = traverse.bfs(links, seeds, "in", 3).join(graph.nodes("file_path"), "id")
    fan = links.groupBy(F.col("source").alias("seed")).agg(F.countDistinct("target").alias("fan_out"))
    file_ = F.when(~is_test(F.col("file_path")), F.col("file_path"))
    per = met.groupBy("seed").agg(F.count(F.when(F.col("depth") == 1, 1)).alias("direct"), F.count(F.when(F.col("depth") > 1, 1)).alias("indirect"), F.countDistinct(file_).alias("files"))
    per = per.join(fan, "seed", "left").fillna(0, ["fan_out"])
    risk = (F.col("direct") + F.col("indirect")) * 5 + F.col("fan_out") * 10 + F.col("indirect") * 3 + F.col("files") * 2
    return per.withColumn("risk", F.least(risk, F.lit(100)).cast("long"))


def changed_symbols(graph: PropertyGraph, hunks: DataFrame) -> DataFrame:
    """id, file_path of symbols whose lines overlap a hunk (file_path, first, last) of their file."""
    n = graph.nodes("file_path", "start_line", "end_line")
    return n.join(hunks, "file_path").filter("start_line <= last and end_line >= first").select("id", "file_path").distinct()


def change_impact(graph: PropertyGraph, paths: DataFrame) -> DataFrame:
    """file_path, symbols, affected, risk of changed files: distinct symbols that depend on theirs within two steps; risk none, low (to 5), medium (to 15), high."""
    mine = graph.nodes("file_path").join(paths, "file_path", "left_semi")
    met = traverse.bfs(graph.links(*CALL_KINDS), mine.select("id"), "in", 2)
    per = mine.join(met.select(F.col("seed").alias("id"), F.col("id").alias("hit")), "id", "left").groupBy("file_path").agg(F.countDistinct("id").alias("symbols"), F.countDistinct("hit").alias("affected"))
    a = F.col("affected")
    return per.withColumn("risk", F.when(a == 0, "none").when(a <= 5, "low").when(a <= 15, "medium").otherwise("high"))


def taint(links: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 5) -> DataFrame:
    """source, sink, depth: sinks that data of a source can reach, at the least depth."""
    met = traverse.bfs(links, sources, "out", max_depth).join(sinks.select("id").distinct(), "id", "left_semi")
    return met.select(F.col("seed").alias("source"), F.col("id").alias("sink"), "depth")


def named_like(graph: PropertyGraph, endings: tuple[str, ...]) -> DataFrame:
    """Nodes whose qualified name ends with one of ``endings``."""
    test = reduce(lambda a, b: a | b, [F.endswith("qualified_name", F.lit(x)) for x in endings])
    return graph.nodes("qualified_name").filter(F.coalesce(test, F.lit(False))).select("id")


# --- references, files ---


def classify_references(graph: PropertyGraph) -> DataFrame:
    """eid, class, id of references without node: external by their text, else internal by qualified name, by unique name, by unique last part; else unknown."""
    from graphloom.operators.storage import dangling_edges

    refs = dangling_edges(graph).select(F.col("id").alias("eid"), "target_text")
    after = F.regexp_extract("target_text", "^[^:]*:(.*)$", 1)
    last = F.regexp_extract("target_text", r"([A-Za-z_]\w*)\W*$", 1)
    refs = refs.select("eid", F.startswith("target_text", F.lit("<external>")).alias("external"), after.alias("qualified_name"), last.alias("name"))
    n = graph.nodes("name", "qualified_name")
    by_q = n.groupBy("qualified_name").agg(F.min("id").alias("q_id"))
    by_n = n.groupBy("name").agg(F.min("id").alias("n_id"), F.count("*").alias("same")).filter("same = 1").drop("same")
    j = refs.join(by_q, "qualified_name", "left").join(by_n, "name", "left")
    kind = F.when(F.col("external"), "external").when(F.col("q_id").isNotNull(), "qualified_name").when(F.col("n_id").isNotNull(), "unique_name").otherwise("unknown")
    return j.select("eid", kind.alias("class"), F.when(~F.col("external"), F.coalesce("q_id", "n_id")).alias("id"))


def resolve_references(graph: PropertyGraph) -> DataFrame:
    """eid, target, provenance: references without node get the node their text names, else stay unresolved."""
    c = classify_references(graph)
    return c.select("eid", F.col("id").alias("target"), F.when(F.col("id").isNotNull(), "resolved").when(F.col("class") == "external", "external").otherwise("unresolved").alias("provenance"))


def staleness(saved: DataFrame, now: DataFrame) -> DataFrame:
    """path, state: new (no record), baseline (recorded time 0), stale (time differs), fresh, or gone. Both: path, modified_at."""
    j = now.select("path", F.col("modified_at").alias("m")).join(saved.select("path", F.col("modified_at").alias("s"), F.lit(True).alias("had")), "path", "full_outer")
    state = F.when(F.col("m").isNull(), "gone").when(F.col("had").isNull(), "new").when(F.col("s") == 0, "baseline").when(F.col("s").eqNullSafe(F.col("m")), "fresh").otherwise("stale")
    return j.select("path", state.alias("state"))


def consistency(graph: PropertyGraph, files: DataFrame) -> DataFrame:
    """path, problem: files with symbols but no file record, and records without symbols."""
    known = files.select("path").filter("path is not null").distinct()
    used = graph.nodes("file_path", "kind").filter("kind in ('function', 'method', 'class', 'file')").select(F.col("file_path").alias("path")).filter("path is not null").distinct()
    return used.join(known, "path", "left_anti").withColumn("problem", F.lit("no record")).unionByName(known.join(used, "path", "left_anti").withColumn("problem", F.lit("no symbols")))


# --- bodies ---

# Patterns of risky code with their severity, tried in this order within a category, without regard to case.
SECURITY_RULES = (
    ("sql_injection", "high", r"""(?:execute|query|executemany)\s*\(\s*(?:["']\s*\+|["'].*?\+\s*\w|\+\s*.*?["']|f"[^"]*\{)"""),
    ("sql_injection", "high", r"""\"\s*SELECT\s+.*\"\s*\+\s*\w+"""),
    ("sql_injection", "medium", r"""["']\s*\+\s*\w+\s*\+\s*["']"""),
    ("hardcoded_secret", "critical", r"""(?:password|passwd|pwd)\s*[:=]\s*["'](?!\s*["'])(.+?)["']"""),
    ("hardcoded_secret", "critical", r"""(?:secret|api_key|apikey|api_secret)\s*[:=]\s*["'](?!\s*["'])(.+?)["']"""),
    ("hardcoded_secret", "high", r"""(?:token|auth_token|access_key)\s*[:=]\s*["'](?!\s*["'])(.+?)["']"""),
    ("hardcoded_secret", "critical", r"""(?:private_key|secret_key)\s*[:=]\s*["'](?!\s*["'])(.+?)["']"""),
    ("command_injection", "critical", r"""os\.system\s*\(\s*(?:["'].*?\+\s*|\+\s*.*?["']|f"[^"]*\{|\w+\s*\+)"""),
    ("command_injection", "high", r"""(?:os\.popen|subprocess\.(?:call|run|Popen))\s*\(\s*["'].*?\+\s*"""),
    ("command_injection", "high", r"""subprocess\.(?:call|run|Popen)\s*\(\s*\w+\s*\+"""),
    ("command_injection", "high", r"""Runtime\.getRuntime\(\)\.exec\s*\(\s*\w+\s*\+"""),
    ("deserialization", "high", r"""pickle\.(?:load|loads)"""),
    ("deserialization", "medium", r"""yaml\.load\s*\("""),
    ("deserialization", "high", r"""ObjectInputStream.*\.readObject"""),
)
# The two signs of path_traversal, severity high; both must show, with regard to case.
PATH_CONCAT = r"""["'](?:[^"']*\/[^"']*)?["']\s*\+|\+\s*["']"""
FILE_CALL = r"""(?:open|file|File|FileInputStream|FileReader|Files\.)\s*\("""
# What structural searches look for in bodies.
STRUCTURES = {"try_except": r"(?i)try\s*[:{]", "for_loop": r"(?i)for\s+\w+\s+in\s+|for\s*\(", "while_loop": r"(?i)while\s+", "lambda": r"(?i)lambda\s+|=>", "decorator": r"@\w+", "defer": r"\bdefer\b"}


def security_findings(graph: PropertyGraph) -> DataFrame:
    """id, category, severity: the first pattern of each category that a body shows; one pass over the bodies."""
    f = functions(graph, "body").filter("body is not null")
    found = []
    for category in dict.fromkeys(c for c, _, _ in SECURITY_RULES):
        rules = [(s, f"(?i){p}") for c, s, p in SECURITY_RULES if c == category]
        sev = reduce(lambda w, r: w.when(F.rlike("body", F.lit(r[1])), r[0]), rules[1:], F.when(F.rlike("body", F.lit(rules[0][1])), rules[0][0]))
        found.append(F.when(sev.isNotNull(), F.struct(F.lit(category).alias("category"), sev.alias("severity"))))
    both = F.rlike("body", F.lit(PATH_CONCAT)) & F.rlike("body", F.lit(FILE_CALL))
    found.append(F.when(both, F.struct(F.lit("path_traversal").alias("category"), F.lit("high").alias("severity"))))
    return f.select("id", F.explode(F.array_compact(F.array(*found))).alias("r")).select("id", "r.category", "r.severity")


def find_structure(graph: PropertyGraph, structure: str, per_file: int = 5) -> DataFrame:
    """file_path, id, start_line: symbols whose body shows the structure, at most ``per_file`` a file in order of line and id (what the feature shows)."""
    from pyspark.sql import Window

    n = graph.nodes("file_path", "start_line", "body").filter(F.rlike("body", F.lit(STRUCTURES[structure]))).select("id", "file_path", "start_line")
    w = Window.partitionBy("file_path").orderBy(F.col("start_line").asc_nulls_last(), "id")
    return n.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_file).drop("k")


def quality_gates(graph: PropertyGraph) -> DataFrame:
    """gate, subject: functions of more than 50 lines, files without a test file of their name, pairs of files that call each other."""
    f = functions(graph, "file_path", "start_line", "end_line")
    long_ = f.filter("end_line - start_line > 50").select(F.lit("complexity").alias("gate"), F.col("id").alias("subject"))
    files = graph.nodes("file_path", "kind").filter("kind = 'file' and file_path is not null").select("file_path").distinct()
    base = F.regexp_replace(_base(F.col("file_path")), "^test_|_test$|Test$", "")
    tested = files.filter(is_test(F.col("file_path"))).select(base.alias("base")).distinct()
    bare = files.filter(~is_test(F.col("file_path"))).withColumn("base", base).join(tested, "base", "left_anti").select(F.lit("test_coverage").alias("gate"), F.col("file_path").alias("subject"))
    n = graph.nodes("file_path")
    e = graph.links("calls").join(n.select(F.col("id").alias("source"), F.col("file_path").alias("a")), "source").join(n.select(F.col("id").alias("target"), F.col("file_path").alias("b")), "target").filter("a <> b").select("a", "b").distinct()
    mutual = e.filter("a < b").join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").select(F.lit("dependency_direction").alias("gate"), F.concat_ws(" <> ", "a", "b").alias("subject"))
    return long_.unionByName(bare).unionByName(mutual)


def _params(signature: Column) -> Column:
    inner = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    return F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(inner, ",")))


def api_changes(snapshots: DataFrame) -> DataFrame:
    """snap, qualified_name, before, after, bump: signatures that changed to the next snapshot, by number of parameters: fewer is major, more minor, else patch."""
    one = snapshots.filter("qualified_name is not null").groupBy("snap", "qualified_name").agg(F.max(F.regexp_replace(F.coalesce("signature", F.lit("")), r"\s+", "")).alias("s"))
    old = one.select((F.col("snap") + 1).alias("snap"), "qualified_name", F.col("s").alias("was"))
    j = one.join(old, ["snap", "qualified_name"]).filter("s <> was and s <> '' and was <> ''")
    a, b = _params(F.col("was")), _params(F.col("s"))
    return j.select("snap", "qualified_name", a.alias("before"), b.alias("after"), F.when(b < a, "major").when(b > a, "minor").otherwise("patch").alias("bump"))
