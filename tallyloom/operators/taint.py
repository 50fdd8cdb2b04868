"""Taint: which variables user input reaches, what cleans it, which calls register routes, and how sure a path is."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators.graphs import cut

IDENTIFIER = r"[A-Za-z_$][\w$]*"
#: Names of functions that neutralise input, and those of them that must be the whole name.
SANITIZERS = (
    "escape", "sanitize", "validate", "clean", "purify", "encode", "encodeURI", "encodeURIComponent", "htmlspecialchars", "parseInt", "parseFloat", "Number", "Boolean",
    "DOMPurify", "xss", "bleach", "parameterize", "placeholder", "prepare",
)
WHOLE_ONLY = ("validate", "number", "boolean", "clean")
#: Methods that register routes, those that also look things up, receivers that are routers, and receivers that aren't.
ROUTE_METHODS = "get|post|put|patch|delete|all|use|Get|Post|Put|Patch|Delete|Handle|HandleFunc"
LOOKUPS = ("get", "use", "all")
ROUTERS = ("app", "router", "server", "api", "route", "routes", "express")
NO_ROUTERS = (
    "config", "redis", "cache", "memcached", "map", "set", "weakmap", "store", "state", "localstorage", "sessionstorage", "storage", "fs", "promises", "path",
    "axios", "http", "https", "got", "fetch", "superagent", "request", "client", "window", "document", "navigator", "process", "env", "json", "object", "reflect",
    "headers", "params", "query", "session", "cookies", "db", "database", "model", "repo", "repository", "this", "self", "obj", "options", "opts", "settings", "prefs",
)
#: Callees that are sinks, by kind; a name is met by the kinds in this order.
SINKS = {
    "sql": ("query", "execute", "raw", "$queryRaw", "createQueryBuilder", "findBySql", "sequelize.query"),
    "command": ("exec", "execSync", "spawn", "spawnSync", "execFile", "system", "popen", "shell_exec", "passthru", "check_output", "check_call", "Popen"),
    "file": ("readFile", "writeFile", "appendFile", "createReadStream", "createWriteStream", "open", "unlink", "rm", "rename"),
    "response": ("send", "write", "end", "render"),
    "deserialize": ("JSON.parse", "yaml.load", "deserialize", "unserialize", "pickle.loads"),
    "redirect": ("redirect", "location.assign", "location.replace"),
    "eval": ("eval", "Function", "setTimeout", "setInterval", "execScript"),
    "ssrf": (
        "axios.get", "axios.post", "axios.put", "axios.delete", "axios.request", "http.get", "http.request", "https.get", "https.request", "fetch", "got.get", "got.post",
        "superagent.get", "requests.get", "requests.post", "requests.request", "urllib.request.urlopen", "urlopen",
    ),
    "nosql": ("findOne", "findOneAndUpdate", "findOneAndDelete", "findOneAndReplace", "aggregate", "mapReduce"),
}
#: The weakness of each kind of sink, and entries that aren't reached from outside.
WEAKNESSES = {
    "sql": "CWE-89", "command": "CWE-78", "file": "CWE-22", "response": "CWE-79", "deserialize": "CWE-502", "redirect": "CWE-601", "eval": "CWE-94", "ssrf": "CWE-918",
    "nosql": "CWE-943",
}
INNER_ENTRIES = ("sdk_export", "angular_component", "react_route", "react_component")
#: The least confidence of a reported path, and how many lines around a path in a file a sanitizer may stand.
LEAST_CONFIDENCE = 0.1
NEAR_LINES = 50
#: Lines of a bin in the join of paths with sanitizers; a span of one line, with those around it, is in two bins at most.
BIN = 128
#: Fixed value: kinds of sinks that raise the confidence.
GRAVE = ("sql", "command", "eval", "deserialize", "ssrf", "nosql")


def is_sanitizer(callee: Column) -> Column:
    """Whether a call's last name is a sanitizer's, in any case, or begins with one that a capital, a digit, _ or - follows; false for null."""
    last = F.substring_index(callee, ".", -1)
    begins = "|".join(s for s in SANITIZERS if s.lower() not in WHOLE_ONLY)
    return F.coalesce(last.rlike(f"^(?i:{'|'.join(SANITIZERS)})$") | last.rlike(f"^(?i:{begins})[_A-Z0-9-]"), F.lit(False))


def is_route(callee: Column) -> Column:
    """Whether a call registers a route: of methods that may be lookups only on what is named as a router, of others on all but known others; false for null."""
    whole = rf"^(.+)\.({ROUTE_METHODS})$"
    receiver = F.lower(F.substring_index(F.regexp_extract(callee, whole, 1), ".", -1))
    router = receiver.isin(*ROUTERS) | receiver.rlike("(router|routes)$") | (receiver.endswith("app") & (F.length(receiver) > 3))
    found = F.when(F.lower(F.regexp_extract(callee, whole, 2)).isin(*LOOKUPS), router).otherwise(~receiver.isin(*NO_ROUTERS))
    return F.coalesce(callee.rlike(whole) & found, F.lit(False))


def _score(hops: int, sanitizers: int, argument: int, grave: int, tainted: int) -> float:
    score = 0.85 - hops * 0.08
    score -= sanitizers * 0.25
    score += 0.1 if argument else 0.0
    score += 0.1 if grave else 0.0
    score *= 1.0 if tainted else 0.45
    return max(0.0, min(1.0, float(Decimal(score).quantize(Decimal("0.01"), ROUND_HALF_UP))))


def confidence(hops: Column, sanitizers: Column, argument: Column, category: Column, tainted: Column) -> Column:
    """0 to 1 with two places, rounded by the sum's exact binary value. It has so few cases that the rule fills a table of them."""
    cases = F.array(*(F.lit(_score(*c)) for c in product(range(6), range(4), range(2), range(2), range(2))))
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    at = F.least(hops, F.lit(5)) * 32 + F.least(sanitizers, F.lit(3)) * 8 + bit(argument) * 4 + bit(category.isin(*GRAVE)) * 2 + bit(tainted)
    return F.get(cases, at.cast("int"))


#: A place in a round: assignments before calls, in order, arguments by position.
PLACE = ("phase", "ord", "i")
#: A way back to the same variable comes later than it was reached.
AHEAD = "not (file = to_file and name = to)"


def _joined(before: DataFrame, after: DataFrame, rounds: int) -> DataFrame:
    """Paths along `before` and then along `after`, whole if the former is. Between them a round begins unless the latter enters behind where the former leaves.

    An empty path, which leads from a variable to itself, enters nowhere. Paths that take all rounds or lead back come too late and are left out.
    """
    turn = F.when(F.col("p.leave") < F.col("q.enter"), 0).otherwise(1)
    cost = F.when(F.col("p.enter").isNull(), F.col("q.cost")).otherwise(F.col("p.cost") + turn + F.col("q.cost")).alias("cost")
    met = before.alias("p").join(after.alias("q"), (F.col("p.to_file") == F.col("q.file")) & (F.col("p.to") == F.col("q.name")))
    met = met.select("p.file", "p.name", F.coalesce("p.enter", "q.enter").alias("enter"), cost, "q.leave", "q.to_file", "q.to", "p.whole")
    return met.where(F.col("cost") < rounds).where(AHEAD)


def _contracted(arrows: DataFrame, starts: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(paths, arrows): to each variable that one arrow alone leads to a path from the last one before it that several lead to or input starts in (a head), and
    paths of one arrow to a head that come from one. What no head leads to within the rounds is left out.

    An arrow is a row from (file, name) to (to_file, to) at a place; a path has the place where it enters, the rounds that begin on it and the place where it
    leaves. Paths are doubled until they are whole, that is begin at a head: the turns are the logarithm of the longest one, a variable has one path at any time,
    and a circle of single arrows ends where a path leads back or takes all rounds.
    """
    to = [F.col("to_file").alias("file"), F.col("to").alias("name")]
    counts = arrows.groupBy(*to).agg(F.count(F.lit(1)).alias("n")).join(starts.select("file", "name", F.lit(True).alias("start")), ["file", "name"], "left")
    counts = counts.select(F.col("file").alias("to_file"), F.col("name").alias("to"), F.expr("n = 1 and start is null").alias("alone"))
    arrows = cut(arrows.join(counts, ["to_file", "to"]), "arrows")
    steps = arrows.select("file", "name", F.struct(*PLACE).alias("enter"), F.lit(0).alias("cost"), F.struct(*PLACE).alias("leave"), "to_file", "to", F.lit(False).alias("whole"), "alone")
    short, several = steps.where("alone").drop("alone"), steps.where("not alone").drop("alone")
    heads = cut(several.select(*to).unionByName(starts.select("file", "name")).distinct(), "heads")
    none = F.lit(None).cast(steps.schema["enter"].dataType)
    paths = heads.select("file", "name", none.alias("enter"), F.lit(0).alias("cost"), none.alias("leave"), F.col("file").alias("to_file"), F.col("name").alias("to"), F.lit(True).alias("whole"))
    while not short.isEmpty():
        longer = cut(_joined(paths.unionByName(short), short, rounds), "paths")
        paths, short = paths.unionByName(longer.where("whole")), longer.where("not whole")
    return paths.where("enter is not null"), cut(_joined(paths, several, rounds), "arrows")


def tainted(assignments: DataFrame, calls: DataFrame, functions: DataFrame, rounds: int = 8) -> DataFrame:
    """(file, name, round): variables that user input reaches within so many rounds, and the first round in which it does.

    assignments (file, ord, name, expr), calls (file, ord, callee, args), functions (name, file, params). A round goes through the assignments in order, each
    seeing what those before it found in its file, then through the calls, which taint the parameters of all functions of the callee's last name by position.
    So a variable is reached at a time (round, calls or not, place), and earlier is never worse: the least times are found by joins of what last improved.
    Arrows from names that nothing is assigned to are left out, and variables that one arrow alone leads to are passed over by paths (`_contracted`) and get their
    times by one join at the end. So the turns are as many as heads on the longest chain, each over arrows between heads alone.
    Rows without a file or name, and empty expressions, taint nothing.
    """
    ids = lambda e: F.array_distinct(F.regexp_extract_all(e, F.lit(f"({IDENTIFIER})"), F.lit(1)))
    place = lambda phase, i: (F.lit(phase).alias("phase"), F.col("ord").cast("long").alias("ord"), i.cast("long").alias("i"))
    # What reads input is reached in the first round at its place, so that its arrows would come no earlier; without a letter there is neither input nor a name.
    read = lambda df: df.where("file is not null").where(F.col("expr").rlike("[A-Za-z_$]")).withColumn("source", X.is_source_expression(F.col("expr"))).withColumn("names", F.when(~F.col("source"), ids(F.col("expr")))).drop("expr")
    by_assignment = read(assignments.where("name <> ''").select("file", "expr", F.col("file").alias("to_file"), F.col("name").alias("to"), *place(0, F.lit(0))))
    args = read(calls.select("file", "ord", F.substring_index("callee", ".", -1).alias("callee"), F.posexplode("args").alias("i", "expr")))
    named = functions.where("file is not null").select(F.col("name").alias("callee"), F.col("file").alias("to_file"), F.posexplode("params").alias("i", "to")).where(F.col("to").rlike(f"^{IDENTIFIER}$"))
    by_call = args.join(named, ["callee", "i"]).select("file", "to_file", "to", *place(1, F.col("i")), "source", "names")
    ways = cut(by_assignment.unionByName(by_call), "ways")
    first = lambda df: df.groupBy(F.col("to_file").alias("file"), F.col("to").alias("name")).agg(F.min("time").alias("time"))
    new = cut(first(ways.where("source").withColumn("time", F.struct(F.lit(1).alias("round"), F.struct(*PLACE).alias("at")))), "times")
    arrows = ways.select("file", F.explode("names").alias("name"), *PLACE, "to_file", "to").where(AHEAD)
    arrows = cut(arrows.join(ways.select(F.col("to_file").alias("file"), F.col("to").alias("name")).distinct(), ["file", "name"], "left_semi"), "arrows")
    paths, arrows = _contracted(arrows, new, rounds)
    turn = F.when(F.col("time.at") < F.col("enter"), 0).otherwise(1)
    along = lambda df, by: df.join(by, ["file", "name"]).withColumn("round", F.col("time.round") + turn + F.col("cost")).where(F.col("round") <= rounds)
    seen, k = new, 0
    while not new.isEmpty():
        k += 1
        best = first(along(new, arrows).select("to_file", "to", F.struct("round", F.col("leave").alias("at")).alias("time")))
        known = seen.groupBy("file", "name").agg(F.min("time").alias("known"))
        new = cut(best.join(known, ["file", "name"], "left").where("known is null or time < known").drop("known"), "times")
        seen = seen.unionByName(new)
        if k % 8 == 0:  # one table again, so that the plan stays short
            seen = cut(seen.groupBy("file", "name").agg(F.min("time").alias("time")), "times")
    times = cut(seen.groupBy("file", "name").agg(F.min("time").alias("time")), "times")
    passed = along(times, paths).select(F.col("to_file").alias("file"), F.col("to").alias("name"), "round")
    return times.select("file", "name", "time.round").unionByName(passed)


def sink_category(callee: Column) -> Column:
    """The first kind of sink that a callee, or what stands behind one of its points, is named as in any case; null if none, and for null."""
    kind = F.lit(None).cast("string")
    for name, names in reversed(SINKS.items()):
        kind = F.when(callee.rlike(rf"(?i)(?:^|\.)(?:{'|'.join(n.replace('.', '[.]').replace('$', '[$]') for n in names)})\z"), name).otherwise(kind)
    return kind


def weakness(category: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in WEAKNESSES.items() for x in pair)), category)


def path_sanitizers(flows: DataFrame, calls: DataFrame) -> DataFrame:
    """(ord, sanitizers): the sanitizing calls (file, line, function) beside each flow, sorted, repeats once; flows without one aren't there.

    A flow's lines in a file are those of its entry, its terminal and its steps ("file:line what"); a sanitizer counts from 50 lines before the first to 50
    behind the last, and anywhere in a file of which the flow names no line. Lines and calls meet in bins of 128 lines, so a file that holds a third of all
    flows and calls is many keys; lines begin at 1. A flow's files are told apart within its row, so that lines needn't move to be gathered.
    """
    step = lambda s: F.struct(F.regexp_extract(s, r"^(.+):(\d+)\s", 1).alias("file"), F.try_to_number(F.regexp_extract(s, r"^(.+):(\d+)\s", 2), F.lit("9999999999")).cast("long").alias("line"))
    ends = [F.struct(F.col(f"{e}_file").alias("file"), F.col(f"{e}_line").cast("long").alias("line")) for e in ("entry", "terminal")]
    via = F.transform(F.filter(F.coalesce("via", F.array().cast("array<string>")), lambda s: s.rlike(r"^(.+):(\d+)\s")), step)
    named = flows.select("ord", F.filter(F.concat(F.array(*ends), via), lambda x: x["file"] != "").alias("ats"))
    of_file = lambda file: F.transform(F.filter("ats", lambda x: x["file"] == file), lambda x: x["line"])
    files = F.transform(F.array_distinct(F.transform("ats", lambda x: x["file"])), lambda file: F.struct(file.alias("file"), F.array_min(of_file(file)).alias("first"), F.array_max(of_file(file)).alias("last")))
    spans = named.select("ord", F.inline(files)).select("ord", "file", F.when(F.col("first").isNotNull(), F.greatest(F.col("first") - NEAR_LINES, F.lit(1))).alias("lo"), (F.col("last") + NEAR_LINES).alias("hi"))
    found = calls.where(is_sanitizer(F.col("callee"))).select("file", F.col("line").cast("long").alias("line"), F.col("callee").alias("function")).distinct()
    bin_of = lambda c: F.floor(F.col(c) / BIN)
    # A span over two bins at most is one row, in the bin of its first line; a call is met there from its own bin and the one before. Longer spans are in all their bins.
    short = bin_of("hi") - bin_of("lo") <= 1
    met = lambda s, f: s.join(f, ["file", "bin"]).where("line between lo and hi").select("ord", "file", "line", "function")
    near = met(spans.where(short).withColumn("bin", bin_of("lo")), found.withColumn("bin", F.explode(F.array(bin_of("line") - 1, bin_of("line")))))
    near = near.unionByName(met(spans.where(~short).withColumn("bin", F.explode(F.sequence(bin_of("lo"), bin_of("hi")))), found.withColumn("bin", bin_of("line"))))
    anywhere = spans.where("lo is null").join(found, "file")
    both = near.unionByName(anywhere.select("ord", "file", "line", "function"))
    return both.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("file", "line", "function"))).alias("sanitizers"))


def taint_paths(flows: DataFrame, calls: DataFrame, reached: DataFrame, most: int | None = None) -> DataFrame:
    """The flows from outside into a sink, with their class, weakness, sanitizers, tainted arguments and confidence; those below 0.1 are left out.

    flows (ord, entry_type, entry_file, entry_line, entry_method, route, handler, terminal_file, terminal_line, callee, args, via, hops): ord is a flow's place;
    of several rows with one ord the least counts. calls (file, line, callee) are all calls, reached (file, name) the variables that input reaches (`tainted`).
    Tainted arguments are those that read input; if none does, those that name a reached variable of the terminal's file; if none does and a step reads
    input, all. Of flows with the same entry place, sink place, callee and steps the first counts. most is a report's limit: so many flows in order,
    before repeats are taken out, as a reader of the first ones expects; None for all. Null args, via and hops are empty and 0; a null callee is no sink.

    Columns: ord, source_file, source_line, source_expr, sink_file, sink_line, sink_function, category, potential_cwe, via, hops, sanitizers,
    tainted_arguments, source_reaches_sink, confidence.
    """
    texts = F.array().cast("array<string>")
    names = [c for c in flows.columns if c != "ord"]
    f = flows.where("ord is not null").groupBy("ord").agg(F.min(F.struct(*names)).alias("f")).select("ord", "f.*")
    f = f.withColumns({"args": F.coalesce("args", texts), "via": F.coalesce("via", texts), "hops": F.coalesce("hops", F.lit(0)).cast("int"), "category": sink_category(F.col("callee"))})
    f = cut(f.where("category is not null").where(~F.coalesce(F.col("entry_type").isin(*INNER_ENTRIES), F.lit(False))), "flows")
    direct = F.filter("args", X.is_source_expression)
    ids = f.where(F.size(direct) == 0).select("ord", F.col("terminal_file").alias("file"), F.posexplode("args").alias("i", "arg"))
    ids = ids.select("ord", "file", "i", "arg", F.explode(F.array_distinct(F.regexp_extract_all("arg", F.lit(f"({IDENTIFIER})"), F.lit(1)))).alias("name"))
    by_name = ids.join(reached.select("file", "name").distinct(), ["file", "name"]).groupBy("ord").agg(F.array_sort(F.collect_set(F.struct("i", "arg"))).alias("hit"))
    by_name = by_name.select("ord", F.col("hit.arg").alias("by_name"))
    all_ = f.join(by_name, "ord", "left").join(path_sanitizers(f, calls), "ord", "left")
    args = F.when(F.size(direct) > 0, direct).when(F.col("by_name").isNotNull(), F.col("by_name"))
    args = args.when(X.is_source_expression(F.array_join("via", " ")), F.col("args")).otherwise(texts)
    all_ = all_.withColumn("sanitizers", F.coalesce("sanitizers", F.array().cast("array<struct<file:string,line:bigint,function:string>>"))).withColumn("tainted_arguments", args)
    reaches = F.size("tainted_arguments") > 0
    all_ = all_.withColumns({"source_reaches_sink": reaches, "confidence": confidence(F.col("hops"), F.size("sanitizers"), F.lit(False), F.col("category"), reaches)})
    all_ = all_.where(F.col("confidence") >= LEAST_CONFIDENCE)
    if most is not None:
        all_ = all_.orderBy("ord").limit(most)
    word = lambda before, c: F.when(F.col(c) != "", F.concat(F.lit(before), c)).otherwise("")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    source = F.concat(F.coalesce(filled("entry_method"), filled("entry_type"), F.lit("entry")), word(" ", "route"), word(" -> ", "handler"))
    out = all_.select(
        "ord", F.col("entry_file").alias("source_file"), F.col("entry_line").alias("source_line"), source.alias("source_expr"), F.col("terminal_file").alias("sink_file"),
        F.col("terminal_line").alias("sink_line"), F.col("callee").alias("sink_function"), "category", weakness(F.col("category")).alias("potential_cwe"), "via", "hops", "sanitizers",
        "tainted_arguments", "source_reaches_sink", "confidence",
    )
    key = ["source_file", "source_line", "sink_file", "sink_line", "sink_function", "via"]
    rest = [c for c in out.columns if c not in key]
    return out.groupBy(*key).agg(F.min(F.struct(*rest)).alias("first")).select(*(F.col(f"first.{c}") if c in rest else F.col(c) for c in out.columns))
