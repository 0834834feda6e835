"""Statement texts: lines, noise, scores, compaction, reporting scale. Windows run within one document."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import words
from statloom.functions.numbers import let


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column has them (Spark compares without regard to case)."""
    taken = {c.lower() for c in columns}
    return [next(x for x in ("_" * k + name for k in range(len(taken) + 1)) if x.lower() not in taken) for name in names]


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def hits(text: Column, parts: list[str]) -> Column:
    """How many of the words a text has."""
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in parts])


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_quotes(text: Column) -> Column:
    return F.translate(text, "’‘“”", "''\"\"")


def glyph_encoded(text: Column) -> Column:
    """Whether over 30 % of the tokens look like /12."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    share = F.size(F.filter(tokens, lambda t: t.rlike(r"^/[0-9]+$"))) / F.nullif(F.size(tokens), F.lit(0))
    return F.coalesce((F.length(text) >= 20) & (share > 0.3), F.lit(False))


def readable(text: Column) -> Column:
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return F.coalesce((F.length(text) >= 100) & contains_any(F.lower(text), words.FINANCIAL) & (control / F.length(text) <= 0.05), F.lit(False))


def lines(docs: DataFrame) -> DataFrame:
    """doc, line_no (from 0), line: control characters removed, ends trimmed."""
    clean = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return docs.select("doc", F.posexplode(F.split(clean, "\n")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


def noise(line: Column) -> Column:
    marks = F.length(F.regexp_replace(line, r"[\p{L}\p{N}\s]+", ""))
    alone = r"[0-9]{4}|[0-9]+\s*/\s*[0-9]+|страница\s+[0-9]+(?:\s+из\s+[0-9]+)?|page\s+[0-9]+(?:\s+of\s+[0-9]+)?"
    return (line == "") | line.rlike(rf"(?iu)^(?:{alone})$") | (marks / F.length(line) > 0.35)


def digit_groups(line: Column) -> Column:
    return F.regexp_count(line, F.lit("[0-9]{3,}"))


def narrative_score(line: Column) -> Column:
    return hits(F.lower(line), words.FINANCIAL) * 4 + digit_groups(line) * 2 + money_words(line) * 2 + structure(line)


def money_words(line: Column) -> Column:
    return F.regexp_count(F.lower(line), F.lit(r"(?U)\b(?:руб|тыс|млн|млрд)\.?\b"))


def structure(line: Column) -> Column:
    return F.when(line.contains(":") | line.contains("|") | line.contains("\t"), 2).otherwise(0)


def extraction_score(line: Column) -> Column:
    low = F.lower(line)
    dense = F.when(digit_groups(line) >= 2, 3).otherwise(0)
    return hits_of(low, sorted({k for ks in words.KEYWORDS.values() for k in ks})) * 6 + hits(low, words.TOTALS) * 3 + hits(low, words.UNITS) * 2 + digit_groups(line) * 2 + dense


def first_of_each(lines: DataFrame) -> DataFrame:
    """The first of a document's lines that are equal but for case and blanks."""
    key = F.lower(squeezed(F.col("line")))
    w = Window.partitionBy("doc", key).orderBy("line_no")
    (n,) = fresh(lines.columns, "place")
    return lines.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def trimmed_lines(text: Column) -> Column:
    """The lines of a text as an array: control characters removed, ends trimmed."""
    return F.transform(F.split(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def by_root(parts: list[str], least: int = 5) -> list[tuple[str, list[str]]]:
    """The parts in groups that share a root, so that a text without a root has none of its group: the substring (of at least
    so many characters, or a whole part) that most of the parts left have, then the next."""
    left, out = list(parts), []
    while left:
        of = Counter(x for p in left for x in {p[i:j] for i in range(len(p)) for j in range(i + min(least, len(p)), len(p) + 1)})
        root = max(of, key=lambda x: (of[x], len(x), x))
        out.append((root, [p for p in left if root in p]))
        left = [p for p in left if root not in p]
    return out


def rooted(parts: list[str]) -> Column:
    """The groups of the parts as one constant: root, n (how many parts are the root itself), the others."""
    others = lambda root, group: F.array(*[F.lit(p) for p in group if p != root]).cast("array<string>")
    return F.array(*[F.struct(F.lit(root).alias("root"), F.lit(group.count(root)).alias("n"), others(root, group).alias("others")) for root, group in by_root(parts)])


def some_of(low: Column, parts: list[str]) -> Column:
    """Whether a text has one of the parts, as one constant of any length."""
    return let(low, lambda t: F.exists(rooted(parts), lambda g: t.contains(g["root"]) & ((g["n"] > 0) | F.exists(g["others"], lambda p: t.contains(p)))))


def hits_of(low: Column, parts: list[str]) -> Column:
    """How many of the parts a text has."""
    count = lambda t, n, g: n + g["n"] + F.size(F.filter(g["others"], lambda p: t.contains(p)))
    return let(low, lambda t: F.aggregate(F.filter(rooted(parts), lambda g: t.contains(g["root"])), F.lit(0), lambda n, g: count(t, n, g)))


def within_budget(lines: Column, max_chars: int) -> Column:
    """The lines (in their order) up to the first that passes the budget of characters; the first line always stays."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.lit(0).cast("bigint").alias("chars"))

    def step(s: Column, x: Column) -> Column:
        full = s["full"] | ((s["n"] > 0) & (s["chars"] + F.length(x["line"]) + 1 > max_chars))
        return F.struct((s["n"] + F.when(full, 0).otherwise(1)).alias("n"), full.alias("full"), (s["chars"] + F.length(x["line"]) + 1).cast("bigint").alias("chars"))

    return F.slice(lines, F.lit(1), F.aggregate(lines, start, step)["n"])


def best_lines(scored: Column, max_lines: int, max_chars: int) -> Column:
    """Of (minus, at, line) the best by score, then place, in the order of their places, within the budget."""
    top = F.slice(F.sort_array(scored), 1, max_lines)
    ordered = F.sort_array(F.transform(top, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))))
    return let(ordered, lambda lines: within_budget(lines, max_chars))


def first_of_equals(lines: Column) -> Column:
    """Of an array of (key, at, ...) the first of each key. Sorted, so that equals are neighbours."""
    return let(F.sort_array(lines), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"])))


def unless_empty(array: Column) -> Column:
    """The rows whose array has elements. A generator: a filter would be pushed below and make the array again there."""
    return F.explode(F.filter(F.array(array), lambda a: F.size(a) > 0))


def compacted(docs: DataFrame, max_chars: int, max_lines: int = 120) -> DataFrame:
    """doc, n_lines, compact: the best-scored lines in their order, within a budget of characters. All of it within the row."""
    fit = lambda x: (F.length(x["line"]) >= 5) & (x["line"].rlike("[0-9]{3}") | some_of(F.lower(x["line"]), words.FINANCIAL)) & ~noise(x["line"])
    placed = F.transform(trimmed_lines(F.col("text")), lambda x, i: F.struct(F.lower(squeezed(x)).alias("key"), i.alias("at"), x.alias("line")))
    score = lambda x: hits_of(F.lower(x), words.FINANCIAL) * 4 + digit_groups(x) * 2 + money_words(x) * 2 + structure(x)
    scored = docs.select("doc", F.transform(first_of_equals(F.filter(placed, fit)), lambda x: F.struct((-score(x["line"])).alias("minus"), x["at"].alias("at"), x["line"].alias("line"))).alias("lines"))
    kept = scored.select("doc", unless_empty(best_lines(F.col("lines"), max_lines, max_chars)).alias("kept"))
    return kept.select("doc", F.size("kept").cast("bigint").alias("n_lines"), F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("compact"))


def extraction_compacted(docs: DataFrame, max_chars: int, max_lines: int = 200) -> DataFrame:
    """doc, n_lines, compact: lines that name a metric or total, have units and amounts, or several amounts; beside those that
    name one, the lines before and after with amounts or units. Sentences without amounts are left out. Then as compacted.

    Lines come in turn, each key once: a line that was taken as a neighbour takes none itself. So of a run of lines that
    would each take the next, every second one takes its neighbours; the runs are read off a string of marks."""
    metrics = sorted({k for ks in words.KEYWORDS.values() for k in ks})

    # What is costly is found once for each line, in stages; noise only for lines with something to take, keys for the rest of these.
    def told(x: Column) -> Column:
        found = lambda low: F.struct(x.alias("line"), hits_of(low, metrics).alias("named"), hits_of(low, words.TOTALS).alias("totals"), hits_of(low, words.UNITS).alias("units"), digit_groups(x).alias("groups"))
        return let(F.lower(x), found)

    def heard(x: Column) -> Column:
        return F.struct(x.alias("x"), ((x["named"] + x["totals"] + x["units"] + x["groups"] > 0) & ~noise(x["line"])).alias("loud"))

    def marked(y: Column, i: Column) -> Column:
        x, loud = y["x"], y["loud"]
        line, named, groups, hit = x["line"], x["named"] > 0, x["groups"], x["named"] + x["totals"] > 0
        good = loud & (F.length(line) >= 3) & ~((groups == 0) & ~named & (F.regexp_count(line, F.lit(r"\S+")) > 20)) & (hit | ((x["units"] > 0) & (groups > 0)) | (groups >= 2))
        score = x["named"] * 6 + x["totals"] * 3 + x["units"] * 2 + groups * 2 + F.when(groups >= 2, 3).otherwise(0)
        key = F.when(loud, F.lower(squeezed(line))).otherwise("")
        return F.struct(key.alias("key"), (~good).alias("bad"), i.alias("at"), line.alias("line"), (loud & hit).alias("hit"), (loud & ((groups > 0) | (x["units"] > 0))).alias("beside"), (-score).alias("minus"))

    base = docs.select("doc", F.transform(F.transform(F.transform(trimmed_lines(F.col("text")), told), heard), marked).alias("lines"))
    # The first good line of each key, back in the order of the text.
    opening = lambda s: F.transform(s, lambda x, p: F.struct(*[x[c].alias(c) for c in ("at", "key", "line", "hit", "beside", "minus")], (~x["bad"] & ((p == 0) | (F.get(s, p - 1)["key"] != x["key"]))).alias("first")))
    first = base.select("doc", F.sort_array(let(F.sort_array("lines"), opening)).alias("l"))
    linked = F.transform("l", lambda x, i: (i > 0) & x["first"] & x["beside"] & F.coalesce(F.get("l", i - 1)["first"] & F.get("l", i - 1)["hit"], F.lit(False)))
    runs = F.regexp_extract_all(F.array_join(F.transform(linked, lambda b: F.when(b, "L").otherwise("U")), ""), F.lit("UL*"), F.lit(0))
    place = F.flatten(F.transform(runs, lambda r: F.sequence(F.lit(0), F.length(r) - 1)))
    # Bound by let: as a column of its own it would be made again for each line, in the lambda.
    at = let(place, lambda turn: F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.get("l", i)["first"] & (F.get(turn, i) % 2 == 0)))
    event = lambda turn, kind, j: F.struct(F.get("l", j)["key"].alias("key"), turn.alias("turn"), F.lit(kind).alias("kind"), j.alias("at"), F.get("l", j)["line"].alias("line"), F.get("l", j)["minus"].alias("minus"))
    taken = F.filter("at", lambda i: F.get("l", i)["hit"])
    beside = lambda kind, d: F.filter(F.transform(F.filter(taken, lambda i: F.coalesce(F.get("l", i + d)["beside"], F.lit(False)) & (i + d >= 0)), lambda i: event(i, kind, i + d)), lambda e: e["line"].isNotNull())
    events = first.select("doc", "l", at.alias("at")).select("doc", F.concat(F.transform("at", lambda i: event(i, 0, i)), beside(1, -1), beside(2, 1)).alias("events"))
    chosen = events.select("doc", first_of_equals(F.col("events")).alias("lines"))
    scored = chosen.select("doc", F.transform("lines", lambda x: F.struct(x["minus"].alias("minus"), x["at"].alias("at"), x["line"].alias("line"))).alias("lines"))
    kept = scored.select("doc", unless_empty(best_lines(F.col("lines"), max_lines, max_chars)).alias("kept"))
    return kept.select("doc", F.size("kept").cast("bigint").alias("n_lines"), F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("compact"))


def chunks(docs: DataFrame, size: int = 12_000, overlap: int = 200, most: int | None = 5) -> DataFrame:
    """doc, chunk_no (from 0), chunk: paragraphs packed into chunks of a size, each begun with the end of the one before; a
    paragraph above the size is cut into slices that overlap. most: how many chunks of a text are kept (None: all)."""
    if not 0 < overlap < size:
        raise ValueError("the overlap must be above 0 and below the size")
    none = F.lit(None).cast("string")
    state = lambda out, now, n: F.struct(out.alias("out"), now.alias("now"), n.cast("int").alias("n"))
    close = lambda s: F.when(s["now"].isNotNull(), F.array_append(s["out"], s["now"])).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(0), F.ceil((F.length(p) - size) / F.lit(float(size - overlap))).cast("int")), lambda k: F.substring(p, k * (size - overlap) + 1, F.lit(size)))
        cut = state(F.concat(close(s), slices), none, F.lit(0))
        tail = F.right(s["now"], F.lit(overlap))
        full = s["now"].isNotNull() & (s["n"] + F.length(p) + 2 > size)
        begun = F.when(tail != "", F.concat(tail, F.lit("\n\n"), p)).otherwise(p)
        packed = F.when(full, state(close(s), begun, F.length(tail) + F.length(p) + 2)).otherwise(state(s["out"], F.when(s["now"].isNull(), p).otherwise(F.concat(s["now"], F.lit("\n\n"), p)), s["n"] + F.length(p) + 2))
        return F.when(F.length(p) > size, cut).otherwise(packed)

    paragraphs = F.split("text", "\n\n")
    folded = F.aggregate(paragraphs, state(F.array().cast("array<string>"), none, F.lit(0)), step, close)
    out = F.when(F.length("text") <= size, F.array("text")).otherwise(folded)
    out = out if most is None else F.slice(out, 1, most)
    return docs.where("text <> ''").select("doc", out.alias("chunks")).select("doc", F.posexplode("chunks").alias("chunk_no", "chunk"))


def scale_of(text: Column) -> Column:
    """1e9, 1e6, 1e3 or 1, from the lines around the first statement title that name one; without a title, from the head."""
    split = F.filter(F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    titles = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(len(t) + 80).alias("n")) for t in words.TITLES])
    kind = lambda t: F.when(contains_any(t, words.BILLIONS), 1e9).when(contains_any(t, words.MILLIONS), 1e6).when(contains_any(t, words.THOUSANDS), 1e3)
    region = lambda l, i: F.array_join(F.slice(l, F.greatest(i, F.lit(1)), F.when(i == 0, 6).otherwise(7)), "\n")

    def found(l: Column) -> Column:
        at = F.filter(F.transform(l, lambda x, i: F.when(F.exists(titles, lambda t: (F.length(x) <= t["n"]) & x.contains(t["t"])), i)), lambda i: i.isNotNull())
        named = lambda at: F.try_element_at(F.filter(F.transform(at, lambda i: kind(region(l, i))), lambda v: v.isNotNull()), F.lit(1))
        return let(at, lambda at: F.when(F.size(at) > 0, named(at)).otherwise(kind(F.substring(F.lower(text), 1, 1500))))

    return F.coalesce(let(split, found), F.lit(1.0))


def scale(docs: DataFrame) -> DataFrame:
    """doc, scale."""
    return docs.select("doc", scale_of(F.col("text")).alias("scale"))
