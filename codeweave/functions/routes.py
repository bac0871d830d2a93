"""Route detection as one expression: docstring first, then the naming habits of each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave.functions.scalars import extension, http_verb, path_in_text
from codeweave.plans.joins import frequent, looked_up

# Words that make a docstring one of a route, verbs looked for in it, and frameworks by their words, in order.
CONTEXT = ("route", "endpoint", "api", "handler", "@app.", "@router.", "handlefunc", "mapping")
VERBS = ("get", "post", "put", "delete", "patch")
FRAMEWORKS = (
    ("flask", ("flask", "@app.")), ("fastapi", ("fastapi",)), ("django", ("django",)), ("express", ("express",)), ("nestjs", ("nestjs",)),
    ("spring", ("spring", "mapping")), ("actix", ("actix",)), ("axum", ("axum",)), ("rocket", ("rocket",)), ("gin", ("gin.",)),
    ("rails", ("rails",)), ("laravel", ("laravel",)), ("phoenix", ("phoenix",)), ("net/http", ("handlefunc", "http.handle")),
)
PYTHON = (("fastapi", ("fastapi",)), ("flask", ("flask", "@app.", "@blueprint.")), ("django", ("django",)), ("starlette", ("starlette",)), ("tornado", ("tornado",)), ("aiohttp", ("aiohttp",)))
SCRIPT = (("nestjs", ("nestjs", "@controller", "@get(", "@post(")), ("fastify", ("fastify",)), ("koa", ("koa",)), ("hapi", ("hapi",)), ("express", ("express",)))
GO = (("gin", ("gin.", "gin ")), ("echo", ("echo.",)), ("chi", ("chi.",)), ("fiber", ("fiber",)), ("gorilla/mux", ("mux", "gorilla")))
JAVA = (("spring", ("@getmapping", "@postmapping", "@requestmapping", "@putmapping", "@deletemapping", "@patchmapping")), ("jaxrs", ("@path", "jax-rs", "javax.ws.rs")), ("micronaut", ("micronaut",)), ("quarkus", ("quarkus",)), ("ktor", ("ktor",)))
RUST = (("actix", ("actix",)), ("axum", ("axum",)), ("rocket", ("rocket", "#[get", "#[post")), ("warp", ("warp",)), ("tide", ("tide",)))
# Extensions by language.
LANGUAGES = (("python", "py"), ("script", "js jsx ts tsx mjs"), ("go", "go"), ("java", "java kt"), ("rust", "rs"), ("ruby", "rb"), ("php", "php"), ("csharp", "cs"), ("elixir", "ex exs"))


def holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def first_of(text: Column, rules: tuple, other: str) -> Column:
    """The first name one of whose words the text holds."""
    out = F
    for name, words in rules:
        out = out.when(holds(text, words), name)
    return out.otherwise(other)


def language(file: Column) -> Column:
    out = F
    for name, extensions in LANGUAGES:
        out = out.when(extension(file).isin(extensions.split()), name)
    return out.otherwise("other")


def framework(lang: Column, file: Column, doc: Column) -> Column:
    """Framework of a handler that its name gave away."""
    paged = F.lower(file).contains("pages/api/") | F.lower(file).contains("app/api/")
    script = F.when(holds(doc, SCRIPT[0][1]), "nestjs").when(paged, "nextjs").otherwise(first_of(doc, SCRIPT[1:], "generic_js"))
    return (
        F.when(lang == "python", first_of(doc, PYTHON, "generic_python")).when(lang == "script", script).when(lang == "go", first_of(doc, GO, "net/http"))
        .when(lang == "java", first_of(doc, JAVA, "spring")).when(lang == "rust", first_of(doc, RUST, "generic_rust")).when(lang == "ruby", "rails")
        .when(lang == "php", "laravel").when(lang == "csharp", "aspnet").when(lang == "elixir", "phoenix").otherwise("generic")
    )


def routes(symbols: DataFrame) -> DataFrame:
    """(method, path, handler_id, file, framework) of functions and methods of symbols(id, name, kind, file, docstring) that serve a route.

    A docstring that speaks of routes decides: its first verb (GET without any) and first path (the name without any). Else the name does: a verb and
    an underscore or capital before the path, an exact verb in a class (whose name is the path), or an ending such as ``handler``.
    """
    s = symbols.where(F.col("kind").isin("Function", "Method")).select("id", "name", "file", F.lower(F.coalesce("docstring", F.lit(""))).alias("doc"))
    s = s.withColumn("low", F.lower("name")).withColumn("lang", language(F.col("file")))
    doc, low, lang = F.col("doc"), F.col("low"), F.col("lang")
    told = holds(doc, CONTEXT)
    said = F
    for v in VERBS:
        said = said.when(doc.contains(f"{v} "), v.upper())
    # A name's verb with what follows it: an underscore in most languages, a capital in camel case.
    snake = F.regexp_extract(low, r"^(?:get|post|put|delete|patch|handle)_(.*)$", 1)
    camel = F.regexp_extract("name", r"^(?:get|find|list|fetch|create|add|update|edit|remove|delete|handle|Get|Post|Put|Delete|Patch|Handle)([A-Z].*)$", 1)
    slashed = lambda c: F.concat(F.lit("/"), F.translate(F.lower(F.regexp_replace(c, "(?<!^)([A-Z])", "/$1")), "_", "/"))
    owner = F.lower(F.element_at(F.split("id", "::"), -2))
    exact = low.isin(*VERBS) & (F.size(F.split("id", "::")) > 1)
    ending = low.rlike("(_handler|_view|_endpoint|_api)$|^.+(handler|controller|route)$")
    bare = F.regexp_replace(low, "(_handler|_view|_endpoint|_api|handler|controller|route)$", "")
    scripted = F.lower("file").rlike("controller|route|handler|api|endpoint")
    by_snake = low.rlike("^(get|post|put|delete|patch|handle)_") & lang.isin("python", "ruby", "php", "rust", "elixir", "other")
    by_camel = (camel != "") & (lang.isin("go", "java", "csharp") | ((lang == "script") & scripted))
    handles = low.rlike("^handle")
    verb = F.when(handles, "UNKNOWN").otherwise(F.coalesce(http_verb(F.col("name")), F.lit("UNKNOWN")))
    method = F.when(told, said.otherwise("GET")).when(exact, F.upper("name")).when(by_snake | by_camel, verb).when(ending, F.coalesce(http_verb(bare), F.lit("UNKNOWN")))
    path = F.when(told, F.coalesce(path_in_text(doc), F.concat(F.lit("/"), low))).when(exact, F.concat(F.lit("/"), F.regexp_replace(owner, "(viewset|view|handler|router|controller)$", ""))).when(by_snake, F.concat(F.lit("/"), F.translate(snake, "_", "/"))).when(by_camel, slashed(camel)).when(ending, F.concat(F.lit("/"), F.translate(bare, "_", "/")))
    found = s.withColumn("method", method).where("method is not null")
    kind = F.when(told, first_of(doc, FRAMEWORKS, "generic")).when(exact & (lang == "python"), "django").otherwise(framework(lang, F.col("file"), doc))
    return found.select("method", path.alias("path"), F.col("id").alias("handler_id"), "file", kind.alias("framework"))


def path_of_file(file: Column) -> Column:
    """Route that a file's place says: from /api/ on without extension, ``route`` or ``index``, ``[x]`` as ``:x``; else its stem."""
    api = F.regexp_extract(file, r"(?i)^.*?(/api/.*)$", 1)
    cut = F.regexp_replace(F.regexp_replace(api, r"\.(tsx?|jsx?)$", ""), "/(route|index)$", "")
    stem = F.lower(F.regexp_replace(F.substring_index(file, "/", -1), r"\.(tsx?|jsx?|py|go|rs)$", ""))
    return F.when(api != "", F.regexp_replace(F.regexp_replace(cut, r"\[", ":"), r"\]", "")).otherwise(F.concat(F.lit("/"), stem))


def handler_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst): CALLS from Route symbols to the function or method of their file that begins first among those that overlap them.

    symbols(id, name, kind, file, start_line, end_line).
    """
    route = symbols.where("kind = 'Route'").select(F.col("id").alias("src"), "file", F.col("start_line").alias("line"), F.col("end_line").alias("high")).where("file is not null and line is not null")
    code = symbols.where("kind in ('Function', 'Method')").where("file is not null and start_line is not null and end_line is not null")
    # No route meets the code of its file: of what ends at its first line or later it needs the first only, which is one for each line.
    ends = code.groupBy("file", F.col("end_line").alias("line")).agg(F.min(F.struct("start_line", "id")).alias("first"))
    lines = ends.unionByName(route.select("file", "line").distinct().withColumn("first", F.lit(None).cast(ends.schema["first"].dataType)))
    later = Window.partitionBy("file").orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = lines.withColumn("first", F.min("first").over(later)).groupBy("file", "line").agg(F.min("first").alias("first")).where("first is not null")
    met = looked_up(route, first, ["file", "line"], frequent(route, ["file", "line"])).where("first.start_line <= high")
    return met.groupBy("src").agg(F.min("first").getField("id").alias("dst"))


def quoted_paths(docs: DataFrame, text: str) -> DataFrame:
    """docs' other columns and each distinct path: quoted strings of less than 200 characters that begin with a slash and have no white space."""
    rest = [c for c in docs.columns if c != text]
    found = docs.select(*rest, F.explode(F.regexp_extract_all(F.col(text), F.lit("[\"'](/[^\"'\\s]{1,198})[\"']"), F.lit(1))).alias("path"))
    return found.where("not startswith(path, '//')").distinct()


def contract(docstring: Column, name: Column) -> tuple[Column, Column]:
    """Method and path of a route symbol: ``@x.verb("/path")`` in its docstring, else ``VERB /path`` in its name."""
    verb = F.upper(F.regexp_extract(docstring, r"(?i)@[\w.]*?(get|post|put|delete|patch|head|options)(?:mapping)?\s*\(", 1))
    plain = F.upper(F.regexp_extract(name, r"^(?i)(?:map)?(get|post|put|delete|patch|head|options)\s", 1))
    path = path_in_text(docstring)
    return F.coalesce(F.nullif(verb, F.lit("")), F.nullif(plain, F.lit("")), F.lit("GET")), F.coalesce(path, F.nullif(F.regexp_extract(name, r"\s(/\S*)", 1), F.lit("")))
