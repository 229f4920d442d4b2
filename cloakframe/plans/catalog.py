"""One query per operator over the given tables; each takes (spark, sf_dir).

Where the tables lack what an operator looks for (code, fences, tokens), the text is derived from
theirs with ``replace`` and ``concat``, always over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.functions.arrays import let, pieces_of, runs
from cloakframe.functions.names import python_names, registry
from cloakframe.functions.patterns import PERSONAL_DATA
from cloakframe.operators import annotate, audit, compare, extract, isolation, literals, masking, policy, risk, sections
from cloakframe.operators import dictionary as dic
from cloakframe.operators import unmask as un
from cloakframe.operators.lookups import lookup, row_weights
from cloakframe.plans import corpus
from cloakframe.plans.mask import audit_of, mask, restore, risk_of
from cloakframe.session import COMPACT, generation, materialize, shared_dir
from cloakframe.sources.audit_log import append_entries
from cloakframe.sources.corpus import read_table, read_table_stream, spread, write_masked
from cloakframe.sources.dictionary_store import (
    decrypt_dictionary,
    encrypt_dictionary,
    read_dictionary,
    read_json_lines,
    write_dictionary,
    write_json_lines,
)
from cloakframe.streaming.audit_stream import ingest_audit, live_totals, read_audit_stream
from cloakframe.streaming.mask_stream import mask_stream

_stored: dict[tuple, DataFrame] = {}

#: A turn's id holds its conversation in the upper and its number in the lower 32 bits: no two turns share it.
TURNS = 1 << 32


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stored table shared by the queries that start from it, as a stored dictionary would be."""
    key = (spark.sparkContext.applicationId, generation(spark), sf_dir, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


def doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "pages").select("page_id", F.col("html").alias("text")), "page_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with an id of their own."""
    table = read_table(spark, sf, "conversations")
    return spread(
        table.select((F.col("conv_id") * TURNS + F.col("turn")).alias("turn_id"), "conv_id", "turn", "role", "text"),
        "turn_id",
    )


def bindings(spark: SparkSession, sf: str) -> DataFrame:
    return _once(
        spark, sf, "bindings", lambda: materialize(extract.symbols(doc_texts(spark, sf), "prose"), "bindings", COMPACT)
    )


def word_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "words", lambda: dic.build_dictionary(bindings(spark, sf)))


def masked_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _once(
        spark,
        sf,
        "masked",
        lambda: materialize(
            masking.rename_all(doc_texts(spark, sf), bindings(spark, sf), word_dictionary(spark, sf), count_as="n_tokens"),
            "masked",
            COMPACT,
        ),
    )


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


# --- derived texts ------------------------------------------------------------------------


def code_like(text: Column) -> Column:
    """Strings, comments and import lines inside running text."""
    out = F.replace(text, F.lit(", "), F.lit(', "'))
    out = F.replace(out, F.lit(". "), F.lit(". # "))
    return F.replace(out, F.lit(".\n"), F.lit(".\nimport "))


def letters(text: Column) -> Column:
    """The letters and blanks of a text, read by the run: taking out every other character costs several times as much."""
    return F.array_join(pieces_of(text, "[A-Za-z ]++"), "")


def edited(docs: DataFrame) -> DataFrame:
    """What came back: by document a changed word, a first line gone, or lines added."""
    turn = F.col("doc_id") % 4
    changed = (
        F.when(turn == 0, F.replace("text", F.lit(" the "), F.lit(" THE ")))
        .when(turn == 1, F.regexp_replace("text", r"^[^\n]*\n", ""))
        .when(turn == 2, F.concat("text", F.lit("\nif gv_900 is None\nimport extra_module\nNewpart by gf_901")))
        .otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    )
    return docs.withColumn("text", changed)


def reply_like(docs: DataFrame) -> DataFrame:
    """A reply with prose, inline code, a fenced block and tokens known and unknown."""
    token = F.format_string("gv_%03d", F.col("turn") + 1)
    return docs.withColumn(
        "text",
        F.concat(
            F.lit("See `"), token, F.lit("`, "), token, F.lit("'s value.\n```python\nimport os\n"),
            token, F.lit(" = gf_99999999("), F.col("role"), F.lit(")\n"), F.col("text"),
            F.lit("\n```\nThen "), token, F.lit(".\n"), F.col("text"),
        ),
    )


SECTION_HEADER = r"^([\p{Lu}][\p{L}]*) "


# --- sources and policy -------------------------------------------------------------------


def corpus_profile(spark, sf):
    lines = F.size(F.split("text", "\n", -1))
    return documents(spark, sf).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(lines).cast("bigint").alias("n_lines"),
        F.sum(F.length("text")).cast("bigint").alias("n_chars"),
    )


def lang_route(spark, sf):
    extension = F.element_at(
        F.array(*[F.lit(e) for e in ("py", "cpp", "txt", "h", "hxx", "md")]), (F.col("doc_id") % 6 + 1).cast("int")
    )
    docs = read_table(spark, sf, "documents").select(
        F.concat_ws("", F.lit("src/"), "source", F.lit("/f"), "doc_id", F.lit("."), extension).alias("path"), "n_chars"
    )
    routed = docs.withColumn("language", policy.language_of(F.col("path")))
    return (
        routed.where(F.col("language").isNotNull())
        .groupBy("language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").cast("bigint").alias("n_chars"))
    )


BANNED = ["*/fr/*", "*.net/en/*", "1*", "*#top", "*page=[2-4]*"]


def policy_banned(spark, sf):
    table = read_table(spark, sf, "pages").select("page_id", "url")
    return table.withColumn("banned", policy.is_banned(F.col("url"), BANNED))


def policy_level_check(spark, sf):
    level = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_id") % 4 + 1)
    requests = read_table(spark, sf, "events").select("event_id", level.alias("level"))
    rules = policy.policy_row(spark, min_scrub_level=2, default_scrub_level=3, block_level_1=True)
    return policy.apply_policy(requests, rules).select(
        "event_id", F.col("effective_level").cast("bigint").alias("effective_level"), "status", "reason"
    )


def policy_layers(spark, sf):
    """Settings of all tiers of a policy, one policy per type of event, folded to one row each."""
    n = F.col("event_id")
    rows = read_table(spark, sf, "events").where("event_id % 97 = 0 OR event_id % 89 = 0").select(
        "event_type", F.when(n % 97 == 0, "repo").otherwise("user").alias("tier"), (n % 4 + 1).cast("int").alias("min_scrub_level"),
        F.when(n % 3 > 0, (n % 3 + 1).cast("int")).alias("default_scrub_level"), (n % 5 == 0).alias("block_level_1"),
        F.when(n % 2 == 0, False).alias("enforce_audit"), (n % 7 == 0).alias("encrypt_maps"),
        F.array(F.concat(F.lit("*."), (n % 6).cast("string"))).alias("banned_patterns"),
    )
    folded = policy.resolve_policy(rows, "event_type")
    return folded.withColumn("banned_patterns", F.array_join("banned_patterns", ","))


def policy_gate(spark, sf):
    """Pages as requests; the policy's globs are some of their hosts, and a few of other forms."""
    table = read_table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    level = F.when(F.col("page_id") % 7 == 0, None).otherwise(F.col("page_id") % 4 + 1)
    hosts = table.where("page_id % 25 = 0").select(
        F.concat(F.lit("*//"), F.regexp_extract("path", "//([^/?#]*)", 1), F.lit("/*")).alias("glob")
    )
    fixed = spark.createDataFrame([(g,) for g in [*BANNED, "*ref=[!a-w]", "?", "*[&?^]page=9*", "*.org/[a-d]?/*"]], "glob string")
    of_repo = hosts.unionByName(fixed).select(
        F.lit("repo").alias("tier"), F.lit(2).alias("min_scrub_level"), F.lit(None).cast("int").alias("default_scrub_level"),
        F.lit(True).alias("block_level_1"), *[F.lit(None).cast("boolean").alias(c) for c in ("enforce_audit", "encrypt_maps")],
        F.array("glob").alias("banned_patterns"),
    )
    of_user = spark.createDataFrame([("user", 4, 3, False, True, False, ["*"])], policy.POLICY_SCHEMA)
    out = policy.policy_gate(table.withColumn("level", level), of_repo.unionByName(of_user), "page_id")
    return out.select("page_id", F.col("effective_level").cast("bigint").alias("effective_level"), "status", "reason")


# --- extraction ---------------------------------------------------------------------------


def occurrences(spark, sf):
    return extract.occurrences(doc_texts(spark, sf))


def occurrences_code_only(spark, sf):
    docs = doc_texts(spark, sf).withColumn("text", code_like(F.col("text")))
    found = extract.occurrences(docs, "python")
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("offset").cast("bigint").alias("offsets"),
        F.sum("line").cast("bigint").alias("lines"),
        F.sum("col").cast("bigint").alias("cols"),
    )


def _doc_words(spark, sf):
    return bindings(spark, sf).select("doc_id", "name")


def protected_anti(spark, sf):
    """The same test as a join, for protected names kept in a table."""
    table = spark.createDataFrame([(n,) for n in python_names()], "name string")
    langs = read_table(spark, sf, "documents").select("doc_id", "lang")
    free = _doc_words(spark, sf).join(F.broadcast(table), "name", "left_anti")
    return (
        free.join(langs, "doc_id")
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("name").alias("n_names"))
    )


def registry_semi(spark, sf):
    hits = _doc_words(spark, sf).join(F.broadcast(registry(spark)), "name")
    return hits.groupBy("name", "language", "profile", "category").agg(F.count(F.lit(1)).alias("n_docs"))


def symbols_by_rule(spark, sf):
    return extract.symbols_by_rule(doc_texts(spark, sf)).select(
        "doc_id", "name", "kind", "scope", F.size("at").cast("bigint").alias("n")
    )


def _turn_symbols(spark, sf):
    """Names of conversation turns, their kind by the role of the speaker."""
    found = extract.symbols(turns(spark, sf), "prose", id_col="turn_id")
    return found.select(
        F.shiftright("turn_id", 32).alias("conv_id"),
        (F.col("turn_id") % TURNS).alias("turn"),
        "name",
        F.when(F.col("turn_id") % 2 == 0, "parameter").otherwise("method").alias("kind"),
        F.concat(F.lit("turn"), F.col("turn_id") % TURNS).alias("scope"),
    )


def code_symbols_python(spark, sf):
    """Declared symbols of code made of the documents: all their words are targets of one assignment."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)))
    targets = F.array_join(F.transform(words, lambda w: F.concat(F.lit("v_"), w)), ", ")
    body = F.when(targets == "", "pass").otherwise(F.concat(targets, F.lit(" = first")))
    code = F.concat(F.lit("class Holder:\n    def run(first):\n        self.kept = first\n        "), body, F.lit("\n"))
    docs = doc_texts(spark, sf).withColumn("text", code)
    return _names_by_scope(docs, "python")


def _names_by_scope(docs: DataFrame, language: str) -> DataFrame:
    """Names are put together inside the row of their text: a row goes out per run of a kind and scope and not per name."""
    declared = docs.select("doc_id", extract.declared_symbols(F.col("text"), language).alias("symbols"))
    together = F.transform(
        runs(F.col("symbols"), "kind", "scope"),
        lambda run: F.struct(
            F.get(run, F.lit(0))["kind"].alias("kind"),
            F.get(run, F.lit(0))["scope"].alias("scope"),
            F.transform(run, lambda s: s["name"]).alias("names"),
        ),
    )
    found = declared.select("doc_id", F.explode(together).alias("s"))
    # The names collected per document are those of its own text.
    names = F.flatten(F.collect_list("s.names"))
    return found.groupBy("doc_id", "s.kind", "s.scope").agg(
        F.sum(F.size("s.names")).cast("bigint").alias("n"), F.sha2(F.array_join(F.array_sort(names), ","), 256).alias("names_sha")
    )


def cpp_like(text: Column) -> Column:
    """C++ made of a text: its words as enum constants, fields, parameters and variables."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0)))
    return let(found, _cpp_of)


def _cpp_of(words: Column) -> Column:
    def listed(before: str, after: str = "") -> Column:
        names = F.transform(words, lambda w: F.concat(F.lit(before), w, F.lit(after)))
        return F.array_join(F.concat(F.array(F.lit(before.split()[-1] + "first" + after)), names), ", ")

    return F.concat(
        F.lit("#define LIMIT 3\nnamespace corpus {\nenum class Mode { "), listed("e_", " = 1"),
        F.lit(" };\nclass Holder : public Base<int> {\n  int "), listed("f_"),
        F.lit(";  // fields\n public:\n  void run(const Part& p_none, "), listed("int p_", " = 2"),
        F.lit(") const {\n    for (int i = 0; i < 3; ++i) { long inner = i; }\n    auto "), listed("v_", " = call(1, 2)"),
        F.lit(";\n  }\n  struct Part { double depth; };\n};\n}\nint corpus::Holder::later() { return 0; }\n"),
    )


def code_symbols_cpp(spark, sf):
    docs = doc_texts(spark, sf)
    return _names_by_scope(docs.withColumn("text", cpp_like(F.col("text"))), "cpp")


def symbol_first(spark, sf):
    return extract.first_symbols(_turn_symbols(spark, sf), "conv_id", "turn")


def comment_spans(spark, sf):
    return extract.comment_spans(pages(spark, sf), "html", id_col="page_id")


def import_names(spark, sf):
    docs = doc_texts(spark, sf).withColumn("text", code_like(F.col("text")))
    found = docs.select("doc_id", F.explode(extract.imported_names(F.col("text"))).alias("name"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n_docs"))


# --- dictionary ---------------------------------------------------------------------------


def dict_build(spark, sf):
    docs = doc_texts(spark, sf)
    words = extract.symbols(docs, "prose").select("doc_id", "name", "kind", "scope")
    personal = extract.symbols_by_rule(docs).select("doc_id", "name", "kind", "scope")
    return dic.build_dictionary(words.unionByName(personal))


def dict_multi_table(spark, sf):
    """The same name gets the same token in every table."""

    def names(table: str, key: str, name: str) -> DataFrame:
        return read_table(spark, sf, table).select(
            F.lit(table).alias("source"),
            F.col(key).alias("key"),
            F.col(name).alias("original"),
            F.lit("string").alias("kind"),
            F.lit("").alias("scope"),
        )

    rows = (
        names("customer", "c_custkey", "c_name")
        .unionByName(names("supplier", "s_suppkey", "s_name"))
        .unionByName(names("part", "p_partkey", "p_name"))
    )
    entries = dic.build_dictionary(rows.withColumnRenamed("original", "name"))
    return lookup(
        rows, entries.select("token", *dic.KEY), dic.KEY, "inner", "key", entries.select(*dic.KEY, "n_docs")
    ).select("source", "key", "token")


def _benchmark_symbols(spark, sf):
    items = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return extract.symbols(items, "prose").select("doc_id", "name", "kind", "scope")


def dict_merge(spark, sf):
    return dic.merge_dictionary(word_dictionary(spark, sf), _benchmark_symbols(spark, sf))


def dict_lookup(spark, sf):
    wanted = _benchmark_symbols(spark, sf).select("doc_id", F.col("name").alias("original"), "kind", "scope")
    entries = word_dictionary(spark, sf).select("token", *dic.KEY)
    found = lookup(wanted, entries, dic.KEY, "left", "doc_id", row_weights(wanted, dic.KEY))
    return found.select(F.col("doc_id").alias("item_id"), "original", "token")


def dict_reverse(spark, sf):
    entries = dic.build_dictionary(
        _turn_symbols(spark, sf).select("conv_id", "name", "kind", "scope").distinct()
    )
    return dic.reverse_map(entries)


def dict_summary(spark, sf):
    personal = dic.build_dictionary(extract.symbols_by_rule(doc_texts(spark, sf)).select("name", "kind", "scope"))
    return dic.summary(word_dictionary(spark, sf).unionByName(personal))


def dict_browse(spark, sf):
    entries = dic.build_dictionary(_turn_symbols(spark, sf).select("name", "kind", "scope"))
    return dic.browse(entries)


def dict_files(spark, sf):
    """Files per token as rows, then how many there are."""
    sources = read_table(spark, sf, "documents").select("doc_id", "source")
    rows = bindings(spark, sf).select("doc_id", "name", "kind", "scope").join(sources, "doc_id")
    files = dic.symbol_files(rows, word_dictionary(spark, sf), "source")
    return files.groupBy("token").agg(F.count(F.lit(1)).alias("n_files"))


def token_hover(spark, sf):
    replies = reply_like(turns(spark, sf))
    found = dic.tokens_in(replies, "turn_id").select("turn_id", "token", "n")
    return dic.describe_tokens(found, word_dictionary(spark, sf))


def token_collisions(spark, sf):
    return dic.collisions(reply_like(turns(spark, sf)), word_dictionary(spark, sf), "turn_id")


def _personal_dictionary(spark, sf) -> DataFrame:
    return dic.build_dictionary(extract.symbols_by_rule(doc_texts(spark, sf)).select("name", "kind", "scope"))


def dict_stored(spark, sf):
    """A dictionary written by prefix and read again; the qualified name of each entry."""
    home = _fresh_dir(spark, "stored")
    write_dictionary(_personal_dictionary(spark, sf), home)
    back = read_dictionary(spark, home)
    return back.select("token", "prefix", "n_docs", dic.qualified(F.col("scope"), F.col("original")).alias("qualified"))


def dict_json_roundtrip(spark, sf):
    """Entries and their files as JSON lines and back."""
    home = _fresh_dir(spark, "lines")
    entries = word_dictionary(spark, sf)
    sources = read_table(spark, sf, "documents").select("doc_id", "source")
    rows = bindings(spark, sf).select("doc_id", "name", "kind", "scope").join(sources, "doc_id")
    write_json_lines(entries, home, dic.symbol_files(rows, entries, "source"))
    back, files, _ = read_json_lines(spark, home)
    counts = files.groupBy("token").agg(F.count(F.lit(1)).alias("n_files"))
    return back.join(counts, "token", "left").select("token", "original", "kind", "scope", "n_docs", "n_files")


def symbol_warnings(spark, sf):
    """Symbols whose kind has no prefix of its own: here the kind is the document's language."""
    langs = read_table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "variable").otherwise(F.col("lang")).alias("kind"))
    found = bindings(spark, sf).select("doc_id", "name").join(langs, "doc_id")
    return dic.warnings(found).select("doc_id", "type", "symbol", "detail")


def dict_encrypt_roundtrip(spark, sf):
    personal = _personal_dictionary(spark, sf)
    stored = materialize(encrypt_dictionary(personal, "a passphrase"), "encrypted")
    return decrypt_dictionary(stored, "a passphrase").select("token", "original", "kind", "scope")


# --- masking ------------------------------------------------------------------------------


def mask_rename(spark, sf):
    docs = doc_texts(spark, sf)
    entries = word_dictionary(spark, sf)
    out = masking.rename(docs, extract.symbols(docs, "prose"), entries, count_as="n_tokens")
    return out.select("doc_id", sha(F.col("text")).alias("masked_sha"), "n_tokens")


def mask_level1(spark, sf):
    """From nothing to masked text: extraction, dictionary, rewriting."""
    out = mask(doc_texts(spark, sf), level=1).docs
    return out.select("doc_id", sha(F.col("text")).alias("masked_sha"), F.col("symbols_scrubbed").alias("n_tokens"))


def quoted_docs(spark, sf):
    """Documents with quoted passages of all lengths."""
    text = F.replace(F.replace("text", F.lit(", "), F.lit(' "')), F.lit(". "), F.lit('" '))
    return doc_texts(spark, sf).withColumn("text", text)


def _masked_and_back(spark, sf, level: int, **options) -> DataFrame:
    docs = quoted_docs(spark, sf)
    out = mask(docs, level=level, **options)
    back = restore(out).select("doc_id", sha(F.col("text")).alias("after"))
    return (
        out.docs.join(back, "doc_id")
        .join(docs.select("doc_id", sha(F.col("text")).alias("before")), "doc_id")
        .select(
            "doc_id", sha(F.col("text")).alias("masked_sha"), (F.col("before") == F.col("after")).alias("same_after_restore")
        )
    )


def mask_level2(spark, sf):
    """Names outside quotes, literals, then the way back."""
    return _masked_and_back(spark, sf, 2)


def mask_level4(spark, sf):
    """All stages for running text; every number above 1 counts as a bound."""
    return _masked_and_back(spark, sf, 4, bound_pattern=masking.ANY_NUMBER)


def _mixed_files(spark, sf) -> DataFrame:
    """Files made of the documents: Python, C++, running text, an unknown type and a banned path by turns; five levels asked for."""
    d = F.col("doc_id").cast("string")
    label = F.concat(F.lit('"customer record of number '), d, F.lit('"'))
    python = F.concat(
        F.lit("import os\n\nclass Holder_"), d, F.lit(":\n    def part_"), d, F.lit("(self, first):\n        label = "), label,
        F.lit("\n        # a note\n        for step in range(25):\n            kept = first + 0x2A\n        return label\n"),
    )
    cpp = F.concat(
        F.lit("#include <map>\nint part_"), d, F.lit("(int first) {\n  // a note\n  auto label = "), label,
        F.lit(";\n  for (int step = 0; step < 25; ++step) { kept(first + 0x2A); }\n  return first;\n}\n"),
    )
    kind = F.col("doc_id") % 5
    path = F.concat(F.when(kind == 4, "secret/f").otherwise("src/f"), d, F.element_at(F.array(*map(F.lit, (".py", ".cpp", ".txt", ".rs", ".py"))), (kind + 1).cast("int")))
    text = F.when(kind == 0, python).when(kind == 1, cpp).otherwise(F.regexp_replace("text", '[0-9"]', ""))
    asked = F.floor(F.col("doc_id") / 5) % 5
    return read_table(spark, sf, "documents").select(
        "doc_id", path.alias("path"), text.alias("text"), F.when(asked > 0, asked).cast("int").alias("level"), F.concat(F.lit("part_"), d).alias("section")
    )


def mask_corpus(spark, sf):
    """One job over files of several languages and levels, under a policy, and its way back."""
    files = spread(_mixed_files(spark, sf), "doc_id")
    policies = spark.createDataFrame(
        [("user", None, 2, None, None, None, None), ("repo", 1, None, False, None, None, ["secret/*"])], policy.POLICY_SCHEMA
    )
    out = corpus.mask_corpus(files, policies, section_col="section")
    back = corpus.restore_corpus(out).select("doc_id", sha(F.col("text")).alias("restored_sha"))
    done = out.docs.select("doc_id", sha(F.col("text")).alias("masked_sha"), "symbols_scrubbed").join(back, "doc_id")
    return out.decisions.join(done, "doc_id", "left").select(
        "doc_id", "language", F.col("effective_level").cast("bigint").alias("level"), "status", "reason", "symbols_scrubbed", "masked_sha", "restored_sha"
    )


def roundtrip_lookalikes(spark, sf):
    """Words that look like tokens, in code and in running text, come back as they were."""
    docs = doc_texts(spark, sf)
    alike = F.format_string("gv_%03d + gf_007 + gv_999999999999 + gv_1000000000000 + gv_1000000000002", F.col("doc_id") % 500)
    code = docs.withColumn("text", F.concat(F.lit("def work(first):\n    kept = "), alike, F.lit(" + first\n")))
    prose = docs.withColumn("text", F.concat(alike, F.lit(" "), F.col("text"), F.lit(" gs_002 gv_001")))
    parts = [
        restore(mask(d, level=1, language=language)).select(
            "doc_id", F.lit(language).alias("language"), sha(F.col("text")).alias("text_sha")
        )
        for d, language in ((code, "python"), (prose, "prose"))
    ]
    return parts[0].unionByName(parts[1])


def masking_risk(spark, sf):
    """Risk and audit of a masking job by what it counted itself."""
    out = mask(quoted_docs(spark, sf), level=2)
    report = risk_of(out).select("doc_id", "total_symbols", F.col("literals.flagged").alias("flagged"), "exposure_level")
    entries = audit_of(out, "doc_id").select(
        F.element_at("source_files", 1).cast("bigint").alias("doc_id"), "symbols_scrubbed", "literals_scrubbed"
    )
    return report.join(entries, "doc_id")


def mask_personal_data(spark, sf):
    """Only what the rule table finds is replaced; the rest of the text stays readable."""
    docs = doc_texts(spark, sf)
    found = materialize(extract.symbols_by_rule(docs), "personal")
    entries = dic.build_dictionary(found)
    resolved = masking.resolve(found, entries).select("doc_id", F.col("token").alias("value"), "at")
    out = masking.substitute(docs, resolved, extract.rule_pattern(PERSONAL_DATA))
    return out.select("doc_id", sha(F.col("text")).alias("masked_sha"))


def mask_span(spark, sf):
    hidden = masking.mask_span(
        F.col("text"), F.lit(11), F.lit(20), lambda t: F.regexp_replace(t, r"[\p{L}\p{N}]", "x")
    )
    return doc_texts(spark, sf).select("doc_id", sha(hidden).alias("masked_sha"))


def strip_comments(spark, sf):
    text = code_like(F.col("text"))
    bare = masking.strip_comments(text, "python")
    return doc_texts(spark, sf).select("doc_id", sha(bare).alias("bare_sha"), F.length(bare).cast("bigint").alias("n_chars"))


def anonymize_comments(spark, sf):
    out = doc_texts(spark, sf).withColumn("text", code_like(F.col("text")))
    return out.select(
        "doc_id",
        sha(masking.placeholder_comments(F.col("text"), "python")).alias("text_sha"),
        masking.comment_count(F.col("text"), "python").alias("n_comments"),
    )


def restored_comments(spark, sf):
    """Placeholders in, placeholders out."""
    docs = doc_texts(spark, sf).withColumn("text", code_like(F.col("text")))
    store = masking.comment_store(docs, "python")
    hidden = docs.withColumn("text", masking.placeholder_comments(F.col("text"), "python"))
    return un.restore_comments(hidden, store).select("doc_id", sha(F.col("text")).alias("text_sha"))


def title_words(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_extract(text, "<title>([^<]*)</title>", 1), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def literals_extract(spark, sf):
    found = literals.literals(pages(spark, sf), id_col="page_id")
    return found.select("page_id", "value", "kind", "offset", "end_offset", "line")


def literals_string_class(spark, sf):
    found = literals.literals(pages(spark, sf), title_words(F.col("text")), id_col="page_id")
    return found.where("kind = 'string'").select("page_id", "offset", "value", "action", "reason", "context")


def strings_by_substring(spark, sf):
    """Quoted passages of all documents that hold a word of the benchmark, also inside a longer word."""
    names = _benchmark_symbols(spark, sf).select("name")
    found = literals.names_in_strings(quoted_docs(spark, sf), names, within="substring")
    return found.select("doc_id", F.explode("known").alias("k")).select("doc_id", F.col("k.at").cast("bigint").alias("at"), "k.name")


def literals_number_class(spark, sf):
    found = literals.literals(doc_texts(spark, sf))
    return found.where("kind = 'number'").select("doc_id", "offset", "value", "action", "reason", "context")


def literals_summary(spark, sf):
    arrays = literals.literal_arrays(pages(spark, sf), title_words(F.col("text")), id_col="page_id")
    return literals.literal_summary(arrays, "page_id")


def mask_literals(spark, sf):
    table = pages(spark, sf)
    arrays = literals.literal_arrays(table, title_words(F.col("text")), id_col="page_id")
    found = materialize(literals.scrubbed_symbols(arrays, "page_id"), "scrubbed")
    out = literals.mask_literals(table, found, dic.build_dictionary(found), id_col="page_id")
    return out.select("page_id", sha(F.col("text")).alias("masked_sha"))


def format_spec_keep(spark, sf):
    text = F.concat(
        F.lit('"'),
        F.replace(F.replace("text", F.lit(", "), F.lit(" %5.2f\\n")), F.lit(". "), F.lit(" %s 100%% \\t%-3d ")),
        F.lit('"'),
    )
    return doc_texts(spark, sf).select("doc_id", sha(masking.keep_format(text)).alias("format_sha"))


def generalize_numbers(spark, sf):
    docs = doc_texts(spark, sf)
    found = materialize(masking.bounds(docs, masking.ANY_NUMBER), "bounds")
    entries = dic.build_dictionary(found.select("doc_id", "name", "kind", "scope").distinct())
    out = masking.generalize_bounds(docs, found, entries, masking.ANY_NUMBER)
    return out.select("doc_id", sha(F.col("text")).alias("masked_sha"))


def isolate_section(spark, sf):
    rows = read_table(spark, sf, "conversations")
    stub = F.concat(F.col("role"), F.lit(": "), F.regexp_extract("text", r"^[^.!?\n]*", 0))
    return sections.isolate_rows(rows, "conv_id", "turn", "text", stub)


def section_rows(spark, sf):
    found = sections.sections(doc_texts(spark, sf), header=SECTION_HEADER)
    return found.select("doc_id", "name", "start_line", "end_line", sha(F.col("body")).alias("body_sha"))


def _line_code(text: Column, template: str) -> Column:
    """Code made of a text: the template once per line, with the line's letters and its number."""
    parts = template.split("%")

    def one(line: Column, i: Column) -> Column:
        fields = {"s": letters(line), "i": i.cast("string"), "n": (i + 1).cast("string")}
        return F.concat(F.lit(parts[0]), *[x for p in parts[1:] for x in (fields[p[0]], F.lit(p[1:]))])

    return F.array_join(F.transform(F.split(text, "\n", -1), one), "")


PYTHON_PARTS = (
    "class Holder_%i:\n    def part_%i(self, a,\n            b=0) -> int:\n        kept = \"%s\"\n\n        return part_%n(a)\ntop_%i = 1\n"
)
CPP_PARTS = "int Holder::part_%i(int a)\n{\n  if (a) { kept(\"%s\"); }\n  return part_%n(a);\n}\nint later_%i(int a);\n"


def _code_sections(spark, sf, template: str, language: str) -> DataFrame:
    docs = doc_texts(spark, sf).withColumn("text", _line_code(F.col("text"), template))
    found = sections.sections(docs, language)
    return found.select("doc_id", "name", "start_line", "end_line", "signature", sha(F.col("body")).alias("body_sha"))


def sections_python(spark, sf):
    return _code_sections(spark, sf, PYTHON_PARTS, "python")


def sections_cpp(spark, sf):
    return _code_sections(spark, sf, CPP_PARTS, "cpp")


def isolate_code(spark, sf):
    """Code made of the documents, each calling into the next one; a third asks for a section that is missing."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    i, n = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    kept = letters(F.col("text"))
    code = F.concat(
        F.lit("import os\nfrom lib import tool_"), i, F.lit("\n\nclass Holder_"), i, F.lit(":\n    def part_"), i,
        F.lit("(self, a):\n        kept = \""), kept, F.lit("\"\n        return shared(a) + part_"), n, F.lit("(a) + unknown_"), i,
        F.lit("(a)\n\ndef shared(x):\n    return tail_"), i, F.lit("(x)\n\ndef tail_"), i, F.lit("(x):\n    return x\n"),
    )
    target = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("part_"), i)).when(F.col("doc_id") % 3 == 1, "missing").otherwise("shared")
    rows = spread(docs.select("doc_id", code.alias("text"), F.lit("python").alias("language"), target.alias("target")), "doc_id")
    out, missed = isolation.isolate_corpus(rows, "target", "language", hops=2)
    warned = missed.select("doc_id", F.concat_ws(": ", "type", "symbol").alias("warning"))
    return out.join(warned, "doc_id", "left").select("doc_id", "isolated", "warning", sha(F.col("text")).alias("text_sha"))


def called_names(spark, sf):
    """Names before a parenthesis, over text with a parenthesis after every comma."""
    body = F.replace("text", F.lit(", "), F.lit(" (, "))
    found = doc_texts(spark, sf).select("doc_id", F.explode(extract.called_names(body)).alias("callee"))
    return found.groupBy("callee").agg(F.count(F.lit(1)).alias("n_docs"))


# --- restoring ----------------------------------------------------------------------------


def unmask(spark, sf):
    out = un.unmask(masked_documents(spark, sf), word_dictionary(spark, sf))
    return out.select("doc_id", sha(F.col("text")).alias("text_sha"), "n_restored")


def unknown_tokens(spark, sf):
    return un.unknown_tokens(reply_like(turns(spark, sf)), word_dictionary(spark, sf), "turn_id")


def unmask_many(spark, sf):
    """Documents of several dictionaries, restored in one job: each by its own."""
    names = read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("map"))
    docs = masked_documents(spark, sf).select("doc_id", "text").join(names, "doc_id")
    entries = word_dictionary(spark, sf).select("token", "original", "n_docs")
    maps = entries.withColumn("map", F.explode(F.array(*map(F.lit, ("en", "fr", "de"))))).withColumn(
        "original", F.when(F.col("map") == "fr", F.concat(F.lit("le_"), "original")).otherwise(F.col("original"))
    )
    out = un.unmask(docs, maps.where("map <> 'de' OR token < 'gv_5'"), map_col="map")
    return out.select("doc_id", "map", "n_restored", F.size("unknown").cast("bigint").alias("n_unknown"), sha(F.col("text")).alias("text_sha"))


def masked_written(spark, sf):
    """Masked texts in a table of their own, with the id of the row they come from."""
    home = _fresh_dir(spark, "masked-table")
    write_masked(masked_documents(spark, sf).select("doc_id", "text", "n_tokens"), home, "documents")
    back = spark.read.parquet(home)
    return back.select("source_doc_id", "source", "n_tokens", sha(F.col("text")).alias("masked_sha"))


def roundtrip(spark, sf):
    out = un.unmask(masked_documents(spark, sf), word_dictionary(spark, sf))
    source = read_table(spark, sf, "documents").select("doc_id", sha(F.col("text")).alias("before"))
    return (
        out.select("doc_id", sha(F.col("text")).alias("after"))
        .join(source, "doc_id")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("before") != F.col("after")).alias("n_different"))
    )


def zones(spark, sf):
    found = un.zones(reply_like(turns(spark, sf)), ["turn_id"])
    return found.select("turn_id", "zone", "zone_type", "language", sha(F.col("content")).alias("content_sha"))


def unmask_zones(spark, sf):
    out = un.unmask_replies(reply_like(turns(spark, sf)), word_dictionary(spark, sf), ["turn_id"])
    return out.select(
        "turn_id",
        sha(F.col("explanation")).alias("explanation_sha"),
        sha(F.col("code")).alias("code_sha"),
        "n_restored",
        F.array_join("new_symbols", ",").alias("new_symbols"),
        F.array_join("new_dependencies", ",").alias("new_dependencies"),
    )


def dependencies(spark, sf):
    docs = doc_texts(spark, sf).withColumn("text", code_like(F.col("text")))
    return compare.dependency_rows(docs)


# --- comparison ---------------------------------------------------------------------------


def section_changes(spark, sf):
    docs = doc_texts(spark, sf)
    return compare.section_changes(docs, edited(docs), header=SECTION_HEADER)


def token_except(spark, sf):
    docs = doc_texts(spark, sf)
    return compare.new_tokens(docs, edited(docs))


def dependency_except(spark, sf):
    docs = doc_texts(spark, sf).withColumn("text", code_like(F.col("text")))
    return compare.new_dependencies(docs, edited(docs))


def confidence(spark, sf):
    docs = doc_texts(spark, sf)
    after = edited(docs)
    return compare.confidence(after, compare.changes(docs, after, header=SECTION_HEADER))


def change_blocks(spark, sf):
    docs = doc_texts(spark, sf)
    blocks = compare.change_blocks(docs, edited(docs))
    return blocks.select(
        "doc_id",
        "block",
        "start_line",
        "end_line",
        "block_type",
        F.size("original_lines").cast("bigint").alias("n_original"),
        F.size("new_lines").cast("bigint").alias("n_new"),
        sha(F.array_join("new_lines", "\n")).alias("new_sha"),
    )


def change_describe(spark, sf):
    docs = doc_texts(spark, sf)
    blocks = compare.change_blocks(docs, edited(docs))
    return blocks.select(
        "doc_id",
        "block",
        "block_type",
        compare.describe_change(F.col("original_lines"), F.col("new_lines")).alias("description"),
    )


def change_annotations(spark, sf):
    docs = doc_texts(spark, sf)
    after = edited(docs)
    out = compare.annotate_changes(after, compare.change_blocks(docs, after))
    notes = F.size(F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"^\s*# --- AI (?:ADDED|REMOVED|MODIFIED): .* ---$")))
    return out.select("doc_id", notes.cast("bigint").alias("n_notes"), sha(F.col("text")).alias("text_sha"))


# --- risk ---------------------------------------------------------------------------------


def structured(spark, sf):
    """Documents with words that code would hold, so that every detector has something to see."""
    text = F.replace(F.replace("text", F.lit(" the "), F.lit(" exp (")), F.lit(" de "), F.lit(" sort(a[1] [2]) < "))
    text = F.replace(F.replace(text, F.lit(" of "), F.lit(" read( SELECT ")), F.lit(" et "), F.lit(" if x > y socket( "))
    return documents(spark, sf).withColumn("text", F.replace(text, F.lit(" que "), F.lit(" md5 loss ")))


def risk_patterns(spark, sf):
    return structured(spark, sf).select(
        "doc_id", F.array_join(risk.structures_in(F.col("text")), "; ").alias("patterns")
    )


def risk_symbol_pivot(spark, sf):
    return risk.symbol_counts(_turn_symbols(spark, sf), "conv_id")


def _report(spark, sf):
    docs = structured(spark, sf)
    counted = literals.literal_counts(literals.literal_arrays(docs))
    counts = risk.symbol_counts(extract.symbols_by_rule(docs))
    report = risk.risk_report(docs, 3, counts=counts, literal_counts=counted)
    return report.join(docs.select("doc_id", "lang", "source"), "doc_id")


def risk_score(spark, sf):
    return _report(spark, sf).select(
        "doc_id",
        "total_symbols",
        F.col("symbols_by_kind.strings").alias("strings"),
        F.col("symbols_by_kind.constants").alias("constants"),
        F.col("literals.flagged").alias("flagged"),
        "exposure_score",
        "exposure_level",
        F.array_join("exposure_reasons", "; ").alias("reasons"),
    )


def risk_json(spark, sf):
    return risk.report_json(_report(spark, sf).drop("lang", "source"))


def risk_rollup(spark, sf):
    return risk.exposure_rollup(_report(spark, sf), "lang", "source")


# --- audit --------------------------------------------------------------------------------


def audit_hide(spark, sf):
    masked = masked_documents(spark, sf).withColumnRenamed("n_tokens", "symbols_scrubbed")
    entries = audit.hide_entries(masked, 1, "doc_id")
    return entries.select(
        "action",
        F.array_join("source_files", ",").alias("source_files"),
        "scrub_level",
        "symbols_scrubbed",
        "warning_count",
        "ghost_output_hash",
        "map_hash",
    )


def audit_reveal(spark, sf):
    restored = un.unmask(masked_documents(spark, sf), word_dictionary(spark, sf))
    entries = audit.reveal_entries(restored, "doc_id", "words", "code")
    return entries.select(
        "action", "input_file", "map_used", "mode", "symbols_restored", "new_symbols_detected", "confidence", "output_hash"
    )


def content_hash(spark, sf):
    text = F.when(F.col("turn") % 3 != 2, F.col("text"))
    digest = audit.content_hash(text)
    return read_table(spark, sf, "conversations").select(
        "conv_id", "turn", digest.alias("digest"), audit.short_hash(digest).alias("short")
    )


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as audit entries: the number in props is how many symbols were handled."""
    n = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    hide = kind.isin("view", "click")
    return read_table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.when(hide, "hide").when(kind.isin("purchase", "signup"), "reveal").otherwise("error").alias("action"),
        F.concat(F.lit("u"), "user_id").alias("user"),
        F.array(F.concat(F.lit("src/f"), "user_id", F.lit(".py")), F.concat(F.lit("lib/g"), "event_id", F.lit(".py"))).alias(
            "source_files"
        ),
        F.when(hide, F.col("event_id") % 5).alias("scrub_level"),
        F.when(F.col("event_id") % 11 == 0, "main_part").alias("function_isolated"),
        F.when(hide, F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(n)).cast("bigint").alias("symbols_scrubbed"),
        (F.col("event_id") % 4).alias("literals_scrubbed"),
        (F.col("event_id") % 2).alias("literals_flagged"),
        F.lit(0).cast("bigint").alias("comments_stripped"),
        (F.col("event_id") % 3).alias("warning_count"),
        F.sha2("props", 256).alias("ghost_output_hash"),
        F.concat(F.lit("in/reply"), "event_id", F.lit(".md")).alias("input_file"),
        F.when(~hide, n).alias("symbols_restored"),
        (F.col("event_id") % 2).alias("new_symbols_detected"),
        F.when(F.col("value") > 10, "HIGH").otherwise("LOW").alias("confidence"),
        F.lit(0).cast("bigint").alias("annotations"),
        F.sha2(F.concat("props", kind), 256).alias("output_hash"),
    )


def audit_recent(spark, sf):
    return audit.recent(event_log(spark, sf), 50, tie_break="event_id").select(
        "event_id", "timestamp", "action", "user"
    )


def audit_totals(spark, sf):
    return audit.totals(event_log(spark, sf))


def audit_detail(spark, sf):
    return audit.detail_lines(event_log(spark, sf).where("action <> 'error'"))


# --- explanations -------------------------------------------------------------------------


def advice_like(docs: DataFrame) -> DataFrame:
    """Turns that give advice about their own words and guess about some of them."""
    word = F.regexp_extract("text", r"([\p{L}_]+)", 1)
    last = F.regexp_extract("text", r"([\p{L}_]+)[^\p{L}_]*$", 1)
    text = F.concat(
        F.lit("Please consider renaming `"), word, F.lit("` to a clear word. "), last,
        F.lit(" should be renamed!\nIt might be that the implementation of "), last,
        F.lit(" is wrong. "), F.col("text"),
    )
    return docs.withColumn("text", F.when(F.col("turn") % 2 == 1, text).otherwise(F.col("text")))


def naming_advice(spark, sf):
    out = annotate.naming_advice(advice_like(turns(spark, sf)), word_dictionary(spark, sf), ["turn_id"])
    return out.select("turn_id", "original", "template", "sentence")


def _stubs(spark, sf):
    return word_dictionary(spark, sf).select("original")


def stub_speculation(spark, sf):
    out = annotate.stub_speculation(advice_like(turns(spark, sf)), _stubs(spark, sf), ["turn_id"])
    return out.select("turn_id", "original", "template", "sentence")


def sentences(spark, sf):
    return annotate.sentences(turns(spark, sf), ["turn_id"])


def annotated_replies(spark, sf):
    docs = advice_like(turns(spark, sf)).select("turn_id", "text")
    notes = annotate.naming_advice(docs, word_dictionary(spark, sf), ["turn_id"])
    out = annotate.footnotes(docs, notes, ["turn_id"])
    return out.select("turn_id", "annotations", sha(F.col("text")).alias("text_sha"))


# --- streams ------------------------------------------------------------------------------


def _fresh_dir(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_audit(spark, sf):
    home = _fresh_dir(spark, "audit")
    append_entries(event_log(spark, sf).drop("event_id"), f"{home}/log")
    runs = ingest_audit(read_audit_stream(spark, f"{home}/log/*"), f"{home}/good", f"{home}/bad", f"{home}/state")
    for run in runs:
        run.awaitTermination()
    return (
        spark.read.parquet(f"{home}/good")
        .groupBy(F.col("log_date").cast("string").alias("log_date"), "action")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("symbols_scrubbed").cast("bigint").alias("symbols"))
    )


def stream_totals(spark, sf):
    home = _fresh_dir(spark, "totals")
    entries = read_table_stream(spark, sf, "events")
    counted = live_totals(entries.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    run = (
        counted.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{home}/totals"))
        .option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{home}/totals").withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd")
    )


def stream_mask(spark, sf):
    home = _fresh_dir(spark, "stream-mask")
    docs = (
        read_table_stream(spark, sf, "documents")
        .select("doc_id", "text")
        .repartition(spark.sparkContext.defaultParallelism, "doc_id")
    )
    mask_stream(docs, f"{home}/dictionary", f"{home}/masked", f"{home}/state").awaitTermination()
    return spark.read.parquet(f"{home}/masked").select("doc_id", sha(F.col("text")).alias("masked_sha"), "n_tokens")


QUERIES = {
    f.__name__: f
    for f in [
        corpus_profile, lang_route, policy_banned, policy_level_check, policy_layers, policy_gate,
        occurrences, occurrences_code_only, protected_anti, registry_semi, symbols_by_rule, code_symbols_python, code_symbols_cpp, symbol_first,
        comment_spans, import_names,
        dict_build, dict_multi_table, dict_merge, dict_lookup, dict_reverse, dict_summary, dict_browse,
        dict_files, token_hover, token_collisions, dict_stored, dict_json_roundtrip, symbol_warnings, dict_encrypt_roundtrip,
        mask_rename, mask_level1, mask_level2, mask_corpus, roundtrip_lookalikes, mask_level4, masking_risk, mask_personal_data, mask_span, strip_comments,
        anonymize_comments, restored_comments, literals_extract, literals_string_class, strings_by_substring,
        literals_number_class, literals_summary, mask_literals, format_spec_keep, generalize_numbers,
        isolate_section, section_rows, sections_python, sections_cpp, isolate_code, called_names,
        unmask, unmask_many, masked_written, unknown_tokens, roundtrip, zones, unmask_zones, dependencies,
        section_changes, token_except, dependency_except, confidence, change_blocks, change_describe,
        change_annotations,
        risk_patterns, risk_symbol_pivot, risk_score, risk_json, risk_rollup,
        audit_hide, audit_reveal, content_hash, audit_recent, audit_totals, audit_detail,
        naming_advice, stub_speculation, sentences, annotated_replies,
        stream_audit, stream_totals, stream_mask,
    ]
}
QUERIES["sections"] = QUERIES.pop("section_rows")
