"""String definitions as a relation: fields' macros expanded by iterated joins.

A definition may name others, own definitions of a file go before those of its library, and expansion stops at a fixed depth. Which
of a library's definitions a file needs is found by following names from its fields, a join a step; their texts are then
built up from the innermost, a join a step, until none changes. Files of one library whose own definitions are equal, or that have none,
are expanded once for all (`_scopes`). Nothing is collected, and libraries may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordcheck.schema import FIELD
from recordcheck.sources.bibtex import MACRO_DEPTH, MONTHS
from recordcheck.storage import stored


#: A file with more definitions, or with longer ones together, is expanded by itself.
SCOPE_DEFINITIONS, SCOPE_CHARS = 64, 4096
#: Tables of more rows, or of longer texts together, are not broadcast.
SMALL_ROWS, SMALL_CHARS = 50_000, 8_000_000


def _is_macro(part: Column) -> Column:
    return part["kind"] == "macro"


def plain_text(parts: str | Column) -> Column:
    """Text of parts of which none is a macro."""
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def _names(rows: DataFrame) -> DataFrame:
    """(file_id, name): the macros that parts name."""
    return rows.select("file_id", F.explode(F.filter("parts", _is_macro)).alias("p")).select("file_id", F.lower("p.text").alias("name")).distinct()


def _sized(table: DataFrame, chars: Column) -> DataFrame:
    """A stored table as a side of a join: broadcast only if its rows and characters, which are counted, are few."""
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars")).first()
    return F.broadcast(table) if size["n"] <= SMALL_ROWS and size["chars"] <= SMALL_CHARS else table


def _spelled_chars(parts: str) -> Column:
    return F.char_length(F.to_json(parts)).cast("bigint")


def _scopes(used: DataFrame, own: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(file_id, scope) of the files in `used`, and own definitions and links with the scope as file_id.

    In one scope are files of one library with equal definitions of their own: whatever they name has one text. The scope spells out
    both, so that no two meet by chance; files with many definitions have scopes of their own.
    """
    sizes = own.groupBy("file_id").agg(F.count("*").alias("n"), F.sum(_spelled_chars("parts") + F.char_length("name")).alias("chars"))
    many = (F.col("n") > SCOPE_DEFINITIONS) | (F.col("chars") > SCOPE_CHARS)
    few = own.join(sizes.filter(~many).select("file_id"), "file_id").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("name", "parts"))).alias("defined"))
    files = used.select("file_id").distinct()
    files = files.join(links.select("file_id", "library").hint("merge"), "file_id", "left") if links is not None else files.withColumn("library", F.lit(None).cast("string"))
    files = files.join(few.hint("merge"), "file_id", "left").join(sizes.filter(many).select("file_id", F.col("file_id").alias("alone")).hint("merge"), "file_id", "left")
    files = stored(files.withColumn("scope", F.to_json(F.struct("library", "defined", "alone"))), "macro-scopes")
    shared = files.filter("defined IS NOT NULL").select("scope", "defined").distinct().select(F.col("scope").alias("file_id"), F.explode("defined").alias("d")).select("file_id", "d.name", "d.parts")
    single = files.filter("alone IS NOT NULL").select("file_id", "scope").join(own, "file_id").select(F.col("scope").alias("file_id"), "name", "parts")
    linked = None if links is None else stored(files.filter("library IS NOT NULL").select(F.col("scope").alias("file_id"), "library").distinct(), "macro-links")
    return files.select("file_id", "scope"), shared.unionByName(single), linked


def needed_definitions(used: DataFrame, own: DataFrame, context: DataFrame | None = None, links: DataFrame | None = None, depth: int = MACRO_DEPTH) -> DataFrame:
    """(file_id, name, parts): all own definitions, and those of the file's library that expanding the parts of `used` can reach.

    context: (name, parts), one library for all files, or (library, name, parts) with links (file_id, library).
    """
    own = own.select("file_id", "name", "parts")
    if context is None:
        return own
    own = stored(own, "macro-own")
    context = _sized(stored(context, "macro-library"), _spelled_chars("parts"))
    named = stored(_names(used.select("file_id", "parts").unionByName(own.select("file_id", "parts"))), "macro-names")
    found = own.limit(0)
    for _ in range(depth):
        asked = named.join(own, ["file_id", "name"], "left_anti").join(found, ["file_id", "name"], "left_anti")
        if links is None:
            got = asked.join(context.select("name", "parts"), "name")
        else:
            got = asked.join(links.select("file_id", "library"), "file_id").join(context.select("library", "name", "parts"), ["library", "name"])
        got = stored(got.select("file_id", "name", "parts"), "macro-found")
        if got.limit(1).count() == 0:
            break
        found = found.unionByName(got).hint("merge")  # a hint does not reach through a union
        named = _names(got)
    return own.unionByName(found)


def _spelled(part: Column) -> Column:
    """A macro without a definition: a month's name, else as it is spelled."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.coalesce(months[F.lower(part["text"])], part["text"])


def _joined(rows: DataFrame, key: list[str], texts: DataFrame, scope: str = "file_id") -> DataFrame:
    """key, parts -> key, text, unresolved, with macros replaced by `texts` (scope, name, text, unresolved) where they have one."""
    parts = rows.select(*dict.fromkeys([*key, scope]), F.posexplode("parts").alias("nth", "p"))
    texts = texts.withColumnsRenamed({"name": "__name", "text": "__text", "unresolved": "__lost"})
    met = parts.withColumn("__name", F.when(_is_macro(F.col("p")), F.lower("p.text"))).join(texts, [scope, "__name"], "left")
    month = F.lower("p.text").isin(*MONTHS)
    lost = F.when(F.col("__name").isNotNull() & ~month, F.array("p.text")).otherwise(F.array().cast("array<string>"))
    text = F.coalesce("__text", F.when(F.col("__name").isNotNull(), _spelled(F.col("p"))).otherwise(F.col("p.text")))
    piece = F.struct("nth", text.alias("text"), F.coalesce("__lost", lost).alias("lost"))
    put = met.groupBy(*key).agg(F.sort_array(F.collect_list(piece)).alias("x"))
    return put.select(*key, F.array_join("x.text", "").alias("text"), F.flatten("x.lost").alias("unresolved"))


def expanded_definitions(definitions: DataFrame, depth: int = MACRO_DEPTH) -> DataFrame:
    """(file_id, name, parts) -> (file_id, name, text, unresolved): texts as a field shows them, which goes `depth` definitions deep.

    The first step takes all macros as they are spelled; each further one puts in the texts of the step before. Definitions that
    name no other are done at once; the rest are joined again until nothing changes.
    """
    definitions = stored(definitions, "macro-definitions")
    key = ["file_id", "name"]
    none = definitions.select(*key, F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("unresolved")).limit(0)
    texts = stored(_joined(definitions, key, none).withColumn("changed", F.lit(True)), "macro-texts")
    nested = _names_of(definitions).join(definitions.select(*key), key, "left_semi").select("file_id", F.col("outer").alias("name")).distinct()
    nested = stored(definitions.join(nested, key, "left_semi"), "macro-nested")
    for _ in range(depth - 1):
        if texts.filter("changed").join(nested.select(*key), key, "left_semi").limit(1).count() == 0:
            break
        again = _joined(nested, key, texts.drop("changed")).withColumnsRenamed({"text": "__text", "unresolved": "__lost"})
        both = texts.join(again, key, "left")
        changed = F.col("__text").isNotNull() & ~(F.col("__text").eqNullSafe(F.col("text")) & F.col("__lost").eqNullSafe(F.col("unresolved")))
        texts = stored(both.select(*key, F.coalesce("__text", "text").alias("text"), F.coalesce("__lost", "unresolved").alias("unresolved"), changed.alias("changed")), "macro-texts")
    return texts.drop("changed")


def _names_of(definitions: DataFrame) -> DataFrame:
    """(file_id, outer, name): the macros that each definition names."""
    inner = definitions.select("file_id", F.col("name").alias("outer"), F.explode(F.filter("parts", _is_macro)).alias("p"))
    return inner.select("file_id", "outer", F.lower("p.text").alias("name")).distinct()


def with_definitions(rows: DataFrame, own: DataFrame, context: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Fields (file_id, pos, field_pos, parts, ...) with text and unresolved under the definitions of their file and its library.

    own: (file_id, name, parts), see `strings`; context and links: see `needed_definitions`. Of several definitions of one name
    a relation may hold one. Fields without macros meet no join.
    """
    plain = ~F.exists("parts", _is_macro)
    key = ["file_id", "pos", "field_pos"]
    used = stored(rows.filter(~plain).select(*key, "parts"), "macro-fields")
    if context is None:
        put = _joined(used, key, expanded_definitions(own.select("file_id", "name", "parts")))
    else:
        files, own, links = _scopes(used, stored(own.select("file_id", "name", "parts"), "macro-own"), links)
        used = stored(used.join(files, "file_id"), "macro-scoped")
        named = used.select(F.col("scope").alias("file_id"), F.filter("parts", _is_macro).alias("parts")).distinct()
        texts = expanded_definitions(needed_definitions(named, own, context, links)).withColumnRenamed("file_id", "scope")
        put = _joined(used, key, _sized(texts, F.char_length("text") + F.char_length("scope")), "scope")
    put = put.withColumnsRenamed({"text": "__text", "unresolved": "__unresolved"})
    joined = rows.join(put, key, "left")
    none = F.array().cast("array<string>")
    return joined.withColumn("text", F.coalesce("__text", plain_text("parts"))).withColumn("unresolved", F.coalesce("__unresolved", none)).drop("__text", "__unresolved")


def items_with_definitions(parsed: DataFrame, context: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Items whose fields' texts are those of their parts under all definitions of the file, wherever it holds them."""
    from recordcheck.sources.bibtex import fields, strings

    macro = F.exists(F.flatten("fields.parts"), _is_macro)
    used = stored(parsed.filter("kind = 'entry'").filter(macro), "macro-entries")
    put = with_definitions(fields(used), strings(parsed), context, links)
    names = [n.partition(":")[0] for n in ("name:", "name_start:", "name_end:", "value_start:", "value_end:", "raw:", "parts:", "text:", "unresolved:")]
    again = put.groupBy("file_id", "pos").agg(F.sort_array(F.collect_list(F.struct("field_pos", F.struct(*names).cast(FIELD).alias("f")))).alias("x"))
    again = again.select("file_id", "pos", F.col("x.f").alias("__fields"))
    plain = F.transform("fields", lambda f: f.withField("text", plain_text(f["parts"])).withField("unresolved", F.array().cast("array<string>")))
    return parsed.join(again, ["file_id", "pos"], "left").withColumn("fields", F.coalesce("__fields", plain)).drop("__fields")
