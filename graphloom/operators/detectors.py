"""Security and widget detectors over sources and their facts.

Pattern detectors are column expressions over lines; those that need the shape
of the code work on the extracted facts. Each gives path, line, category,
confidence and sink, so that ``inventory.grouped`` makes the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import secret_shape

PLACEHOLDER = r"(?i)(your[-_ ]|example|changeme|placeholder|dummy|xxx+|<[^>]+>|\$\{?[A-Za-z_])"
SECRET_NAME = r"(?i)\b\w*(secret|token|password|passwd|api_?key|private_?key|credential)\w*\s*[:=]"
SECRET_WORD = r"(?i)(secret|token|password|passwd|api_?key|private_?key|credential)"
#: The text since the last literal, and a literal with its quotes.
LITERAL = r"""([^"']*)("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
LOCAL_HOST = r"http://(localhost|127\.0\.0\.1|10\.0\.2\.2|0\.0\.0\.0|\[::1\])"
NETWORK = r"(?i)(http|url|uri|client|dio|request|fetch|endpoint|socket|oauth|token)"


def lines_of(files: DataFrame) -> DataFrame:
    """path, line, text of lines that aren't comments."""
    rows = files.select("path", F.posexplode(F.split("source", "\n")).alias("_n", "text"))
    return rows.select("path", (F.col("_n") + 1).cast("bigint").alias("line"), "text").where(~F.col("text").rlike(r"^\s*(//|\*|/\*)"))


def _row(rows: DataFrame, category: str, confidence: Column | str, sink: Column | str) -> DataFrame:
    c = F.lit(confidence) if isinstance(confidence, str) else confidence
    k = F.lit(sink) if isinstance(sink, str) else sink
    return rows.select("path", "line", F.lit(category).alias("category"), c.alias("confidence"), k.alias("sink"))


def hardcoded_secrets(files: DataFrame) -> DataFrame:
    """Literals with a secret's shape, or of 12 characters or more under a secret's name.

    Every literal of a line counts by itself; its name stands before it, after the
    last literal, or is that literal as a key. One cascade, the first branch that holds decides: autofill hints and
    placeholders are no secrets, then shapes, then names.
    """
    before, quoted = (F.regexp_extract_all("text", F.lit(LITERAL), F.lit(i)) for i in (1, 2))
    rows = lines_of(files).withColumns({"_b": before, "_q": quoted}).select("path", "line", "text", "_b", "_q", F.posexplode("_q").alias("_i", "v"))
    rows = rows.withColumns({"v": F.expr("substring(v, 2, length(v) - 2)"), "_b": F.get("_b", F.col("_i")), "_key": F.coalesce(F.get("_q", F.col("_i") - 1), F.lit(""))}).where("v != ''")
    under = F.col("_b").rlike(SECRET_NAME) | (F.col("_key").rlike(SECRET_WORD) & F.col("_b").rlike(r"^\s*\]?\s*[:=,]\s*$")) | ((F.col("_i") == 0) & F.col("text").rlike(SECRET_NAME))
    named = under & (F.length("v") >= 12) & F.col("v").rlike("[0-9]") & ~F.col("v").rlike(r"\s")
    verdict = F.when(F.col("text").rlike("(?i)autofillhints|oauth2?/authorize"), None).when(F.col("v").rlike(PLACEHOLDER), None).when(F.col("v").rlike("^AIza[0-9A-Za-z_-]{20,}"), None).when(secret_shape(F.col("v")).isNotNull(), "high").when(named, "medium")
    return _row(rows.withColumn("c", verdict).where("c IS NOT NULL"), "hardcoded-secret", F.col("c"), F.coalesce(secret_shape(F.col("v")), F.lit("name")))


def firebase_keys(files: DataFrame) -> DataFrame:
    return _row(lines_of(files).where(F.col("text").rlike(r"""["']AIza[0-9A-Za-z_-]{20,}["']""")), "firebase-api-key", "low", "literal")


def insecure_transport(files: DataFrame) -> DataFrame:
    """Clear-text addresses that aren't local, on a line that does something with a network; ``Uri.http`` and ``scheme: 'http'``."""
    rows = lines_of(files)
    t = F.col("text")
    literal = t.rlike(r"""["']http://""") & ~t.rlike(LOCAL_HOST) & t.rlike(NETWORK)
    built = t.rlike(r"\bUri\.http\(") | t.rlike(r"""scheme:\s*["']http["']""")
    return _row(rows.where(literal | built), "insecure-transport", F.when(built, "medium").otherwise("high"), F.when(built, "uri").otherwise("literal"))


def tls_bypass(files: DataFrame) -> DataFrame:
    """Certificate callbacks: always true is risky, always false is fine, anything else is left open."""
    rows = lines_of(files).where(F.col("text").rlike("badCertificateCallback"))
    t = F.col("text")
    verdict = F.when(t.rlike(r"=>\s*true\b|return\s+true\b"), "high").when(t.rlike(r"=>\s*false\b|return\s+false\b"), None).otherwise("blind-spot")
    return _row(rows.withColumn("c", verdict).where("c IS NOT NULL"), "tls-bypass", F.col("c"), "badCertificateCallback")


def webview_risk(files: DataFrame) -> DataFrame:
    t = F.col("text")
    kind = F.when(t.rlike(r"JavaScriptMode\.unrestricted|JavascriptMode\.unrestricted"), "javascript").when(t.rlike(r"allowFileAccess\w*:\s*true"), "file-access").when(t.rlike(r"addJavaScriptChannel|addJavascriptInterface"), "bridge")
    return _row(lines_of(files).withColumn("k", kind).where("k IS NOT NULL"), "webview-risk", F.when(F.col("k") == "bridge", "low").otherwise("medium"), F.col("k"))


def process_execution(files: DataFrame) -> DataFrame:
    """Processes with a shell or with a program or arguments that aren't fixed; what can't be read is a blind spot."""
    t = F.col("text")
    rows = lines_of(files).where(t.rlike(r"\bProcess\.(run|start|runSync)\("))
    args = F.regexp_extract("text", r"Process\.\w+\((.*)$", 1)
    shell = t.rlike(r"runInShell:\s*true") | args.rlike(r"""^\s*["'](/bin/)?(sh|bash|cmd|powershell)["']""")
    fixed = args.rlike(r"""^\s*["'][^"'$]*["']\s*,\s*(const\s*)?\[(\s*["'][^"'$]*["']\s*,?)*\s*\]""")
    verdict = F.when(shell, "high").when(args == "", "blind-spot").when(fixed, None).otherwise("medium")
    return _row(rows.withColumn("c", verdict).where("c IS NOT NULL"), "process-execution", F.col("c"), "Process")


def raw_sql(files: DataFrame) -> DataFrame:
    """Statements built from other texts and without parameters."""
    t = F.col("text")
    rows = lines_of(files).where(t.rlike(r"\.(rawQuery|rawInsert|rawUpdate|rawDelete|execute|customSelect|customStatement)\("))
    dynamic = t.rlike(r"""["'][^"']*\$""") | t.rlike(r"""["']\s*\+""")
    sql = t.rlike(r"(?i)\b(select|insert|update|delete|create|drop|alter)\b")
    params = t.rlike(r"""["']\s*,\s*(\[|variables:)""")
    rows = rows.where(dynamic & (~t.rlike(r"\.execute\(") | sql) & ~(params & ~t.rlike(r"""["'][^"']*\$""")))
    return _row(rows, "raw-sql", "medium", F.regexp_extract("text", r"\.(raw\w+|execute|custom\w+)\(", 1))


def plain_storage(files: DataFrame) -> DataFrame:
    t = F.col("text")
    return _row(lines_of(files).where(t.rlike(r"""(?i)\b(prefs|preferences|sharedpreferences\w*|storage|box)\w*\.(setString|put|write)\(\s*["'][^"']*(token|password|secret|key|credential)""")), "plain-secret-storage", "medium", "preferences")


def weak_randomness(files: DataFrame) -> DataFrame:
    """``Random()`` that makes something secret on its own line; a secret made from a variable that came from one is a blind spot."""
    security = r"(?i)(token|nonce|salt|secret|password|session|otp|key|iv|csrf|challenge|verifier|code)"
    rows = lines_of(files)
    direct = rows.where(F.col("text").rlike(r"\bRandom\(\d*\)") & F.col("text").rlike(security))
    made = rows.withColumn("name", F.regexp_extract("text", r"\b(\w+)\s*=\s*Random\(\d*\)", 1)).where("name != ''").select("path", "name", F.col("line").alias("from"))
    uses = rows.alias("u").join(made.alias("m"), (F.col("u.path") == F.col("m.path")) & (F.col("u.line") > F.col("m.from")) & F.contains("u.text", F.col("m.name")) & F.col("u.text").rlike(security)).select("u.path", "u.line").distinct()
    return _row(direct, "weak-randomness", "high", "Random").unionByName(_row(uses, "weak-randomness", "blind-spot", "Random"))


ALL = [hardcoded_secrets, firebase_keys, insecure_transport, tls_bypass, webview_risk, process_execution, raw_sql, plain_storage, weak_randomness]


def security(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and blind spots of every detector."""
    every = None
    for d in ALL:
        every = d(files) if every is None else every.unionByName(d(files))
    return every.where("confidence != 'blind-spot'"), every.where("confidence = 'blind-spot'").select("path", "line", "category", "sink").distinct()


WIDGETS = {"StatelessWidget": "stateless", "StatefulWidget": "stateful", "ConsumerWidget": "consumer", "ConsumerStatefulWidget": "consumer-stateful", "HookWidget": "hook", "HookConsumerWidget": "hook-consumer"}


def widget_classes(supertypes: DataFrame) -> DataFrame:
    """Classes that extend a widget base, with the kind and whether they are private."""
    kinds = supertypes.sparkSession.createDataFrame(list(WIDGETS.items()), "name string, kind string")
    base = supertypes.where("clause = 'extends'").join(F.broadcast(kinds), "name")
    return base.select("path", F.col("owner").alias("widget"), "kind", F.startswith("owner", F.lit("_")).alias("private"))


def unrendered(widgets: DataFrame, calls: DataFrame, supertypes: DataFrame) -> DataFrame:
    """Widgets that no other code constructs; a widget used through a subclass counts as used."""
    made = calls.select(F.regexp_extract("callee", r"^(?:\w+\.)?([A-Z_]\w*)", 1).alias("widget"), F.col("path").alias("at")).where("widget != ''")
    below = supertypes.where("clause = 'extends'").select(F.col("name").alias("widget"), F.col("owner").alias("sub"))
    via = made.withColumnRenamed("widget", "sub").join(below, "sub").select("widget")
    used = made.select("widget").unionByName(via).distinct()
    return widgets.join(used, "widget", "left_anti")


def unused_params(params: DataFrame, reads: list[DataFrame]) -> DataFrame:
    """Constructor parameters (but ``key``) that none of the read sets has, by (path, owner, name); the first declaration stands."""
    w = Window.partitionBy("path", "owner", "name").orderBy("line", "col")
    out = params.where("name != 'key'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    for r in reads:
        out = out.join(r.select("path", "owner", "name").distinct(), ["path", "owner", "name"], "left_anti")
    return out


def mounted_guards(statements: DataFrame) -> DataFrame:
    """Awaits without a mounted check before the context is used again.

    ``statements`` has path, block, pos, line, awaits, guards and uses (booleans):
    an await needs the next statement to be a guard if that or a later statement
    of the block uses the context.
    """
    w = Window.partitionBy("path", "block").orderBy("pos")
    later = F.max(F.col("uses").cast("int")).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = statements.withColumns({"_next": F.lead("guards").over(w), "_later": later})
    return rows.where(F.col("awaits") & (F.col("_later") == 1) & ~F.coalesce("_next", F.lit(False))).select("path", "block", "line")


def mixed_route_style(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """String navigation in a project that has typed routes somewhere; nothing if it has none."""
    typed = F.broadcast(routes.where("route_class = 'TypedGoRoute'").limit(1).select(F.lit(True).alias("_typed")))
    return calls.where(F.col("callee").rlike(r"^context\.(go|push|replace)(Named)?$")).crossJoin(typed).select("path", "line", "callee")
