"""Registered queries of the core, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import plugs
from inkspark.functions import text as T
from inkspark.operators import chunking, conversations, ledger, retrieval, timestamps, vault
from inkspark.plans.engine import contexts
from inkspark.session import widened

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {"p5_found": timestamps.found, "p5_formats": timestamps.formats}
SQL: dict[str, str] = {}
FLAGSHIP = "search_excerpts"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.first_loaded(table(spark, sf_dir, "notes"), "note_id")


def turns_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.first_loaded(table(spark, sf_dir, "turns"), "turn_id")


def corpus(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    return widened((docs.where(F.col("source_type") == kind) if kind else docs).select(F.col("doc_id").alias("id"), "text"))


def _asked(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = table(spark, sf_dir, "notes").where("note_id % 20 = 0").select("note_id", *columns, "ingested_at")
    return vault.first_loaded(rows, "note_id").withColumnRenamed("note_id", "query_id")


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search queries: titles of the notes whose id is divisible by 20."""
    return _asked(spark, sf_dir, "title").select("query_id", F.col("title").alias("text"))


def tag_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second wording of the same queries: title and tags."""
    return _asked(spark, sf_dir, "title", "tags").select("query_id", F.concat_ws(" ", "title", F.array_join("tags", " ")).alias("text"))


NOTES = "notes1 as (select * from notes where note_id is not null qualify row_number() over (partition by note_id order by ingested_at) = 1)"
TURNS = "turns1 as (select * from turns where turn_id is not null qualify row_number() over (partition by turn_id order by ingested_at) = 1)"
TITLES = "tq as (select note_id query_id, title as text from notes1 where note_id % 20 = 0)"
TAGGED = "gq as (select note_id query_id, concat_ws(' ', title, array_to_string(tags, ' ')) as text from notes1 where note_id % 20 = 0)"
DOCS = "docs as (select doc_id id, text from documents where doc_id is not null)"
TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def bm25_sql(name: str, corpus: str, queries: str, k: int) -> str:
    """CTEs that end in name (query_id, id, score, rank)."""
    return f"""
    {name}_t as (select id, unnest({TERMS}) term from {corpus}),
    {name}_p as (select id, term, count(*) tf from {name}_t group by all),
    {name}_l as (select id, coalesce(len({TERMS}), 0) dl from {corpus}),
    {name}_n as (select count(*) n, avg(dl) mean from {name}_l),
    {name}_d as (select term, count(*) df from {name}_p group by term),
    {name}_q as (select distinct query_id, unnest({TERMS}) term from {queries}),
    {name}_s as (
        select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))), 6) score
        from {name}_q join {name}_p using (term) join {name}_d using (term) join {name}_l using (id), {name}_n group by all),
    {name} as (select *, row_number() over (partition by query_id order by score desc, id) rank from {name}_s qualify rank <= {k})"""


VECTORS = """
    vec_s as (
        select q.vec_id query_id, c.vec_id id, round(list_dot_product(q.embedding::double[], c.embedding::double[]), 6) score
        from embeddings q, embeddings c where q.vec_id % 20 = 0),
    vec as (select *, row_number() over (partition by query_id order by score desc, id) rank from vec_s qualify rank <= 20)"""


def vectors(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.vector_top_k(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), k)


# Text and links.


@query(r"""select doc_id, (len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')) * 13 // 10)::bigint approx_tokens,
    (len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')) * 13 // 10) > 512 is_large from documents""")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.by_size(table(spark, sf_dir, "documents"), "text", F.lit(512))
    return rows.select("doc_id", "approx_tokens", "is_large")


@query("select collection, count(*) n_docs, (coalesce(sum(length(text)), 0) * 2 // 7)::bigint tokens from documents group by 1")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "documents").groupBy("collection")
    return by.agg(F.count("*").alias("n_docs"), T.batch_tokens(F.coalesce(F.sum(F.length("text")), F.lit(0))).alias("tokens"))


@query(rf"""with {NOTES} select note_id, len(l)::bigint n_links, array_to_string(l, ' > ') links from (
    select note_id, list_transform(regexp_extract_all(coalesce(content, ''), '\[\[([^\]]+)\]\]', 1), lambda x: trim(split_part(x, '|', 1))) l from notes1)""")
def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes_once(spark, sf_dir).select("note_id", T.wikilinks(F.col("content")).alias("l"))
    return rows.select("note_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " > ").alias("links"))


TAG_SQL = r"""list_sort(list_distinct(list_filter(list_concat(coalesce(tags, []), regexp_extract_all(coalesce(content, ''), '#([\p{L}\p{N}_/-]+)', 1)), lambda x: x is not null)))"""


@query(f"with {NOTES} select note_id, array_to_string({TAG_SQL}, ', ') tags from notes1")
def note_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_once(spark, sf_dir).select("note_id", F.array_join(T.tags(F.col("content"), F.col("tags")), ", ").alias("tags"))


@query(f"with {NOTES}, t as (select unnest({TAG_SQL}) tag from notes1) select tag, count(*) n_notes from t group by 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes_once(spark, sf_dir).select(F.explode(T.tags(F.col("content"), F.col("tags"))).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n_notes"))


@query("select doc_id, substring(text, 1, 200) || '...' excerpt, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end short, sha256(text) text_key from documents")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(text).alias("excerpt"), T.short_excerpt(text).alias("short"), T.cache_key(text).alias("text_key"))


GRAPH = r"""
    named as (select note_id, path, 0 kind, title as name from notes1 union all select note_id, path, 1, stem from notes1),
    target as (select name target, note_id dst_id from named where name is not null
        qualify row_number() over (partition by name order by coalesce(path, '') desc, kind desc, note_id desc) = 1),
    linked as (select note_id src_id, list_transform(regexp_extract_all(coalesce(content, ''), '\[\[([^\]]+)\]\]', 1), lambda x: trim(split_part(x, '|', 1))) l from notes1),
    each_link as (select src_id, unnest(l) target, generate_subscripts(l, 1) - 1 link_pos from linked),
    graph as (select src_id, link_pos::int link_pos, dst_id from each_link join target using (target))"""


@query(f"with {NOTES}, {GRAPH} select * from graph")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.link_graph(notes_once(spark, sf_dir))


NOTE_CORPUS = "nc as (select note_id id, content as text from notes1)"


@query(f"""with {NOTES}, {TITLES}, {NOTE_CORPUS}, {bm25_sql("hits", "nc", "tq", 10)}, {GRAPH},
    low as (select query_id, greatest(0, min(score) - 0.1) score from hits group by 1),
    new as (select distinct query_id, dst_id from hits join graph on id = src_id and link_pos < 3)
    select query_id, id note_id, score, 0 hop from hits
    union all select query_id, dst_id, low.score, 1 from new join low using (query_id) where not exists (select 1 from hits h where h.query_id = new.query_id and h.id = new.dst_id)""")
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "notes").select("note_id", "content", "title", "stem", "path", "ingested_at")
    once = vault.first_loaded(rows.drop("title", "stem", "path"), "note_id")
    hits = retrieval.bm25(once.select(F.col("note_id").alias("id"), F.col("content").alias("text")), title_queries(spark, sf_dir), 10)
    return vault.expand(hits.select("query_id", F.col("id").alias("note_id"), "score"), vault.link_graph(vault.first_loaded(rows, "note_id")))


SECTIONS = r"""
    whole as (select note_id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) l from notes1 where content is not null and content <> ''),
    lines as (select note_id, unnest(l) line, generate_subscripts(l, 1) pos from whole),
    fenced as (select *, sum(regexp_matches(line, '^```|^~~~')::int) over (partition by note_id order by pos) % 2 f from lines),
    numbered as (select *, sum((regexp_matches(line, '^#{1,6} ') and f = 0)::int) over (partition by note_id order by pos)::int section from fenced),
    sections as (select note_id, section, string_agg(line, chr(10) order by pos) as text from numbered group by 1, 2)"""


@query(f"with {NOTES}, {SECTIONS} select * from sections")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.sections(notes_once(spark, sf_dir))


@query(f"""with {NOTES}, {SECTIONS}, r as (select *, row_number() over (partition by note_id order by section) rank from sections),
    s as (select note_id, count(*) total_chunks, substring(string_agg(substring(text, 1, 200), ' ' order by rank) filter (rank <= 3), 1, 500) parent_summary from r group by 1)
    select note_id, section, total_chunks, parent_summary from sections join s using (note_id)""")
def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vault.parent_context(vault.sections(notes_once(spark, sf_dir)), "note_id", "section", "text")
    return out.select("note_id", "section", "total_chunks", "parent_summary")


# Conversations.

WITH_CONTENT = "content is not null and trim(content) <> ''"
ROLE = "case lower(trim(role)) when 'human' then 'user' else lower(trim(role)) end"


@query(f"""with {TURNS} select turn_id, conv_id, turn_index, {ROLE} as role, content, substring(lag(content) over w, 1, 200) || '...' previous, substring(lead(content) over w, 1, 200) || '...' as next
    from turns1 where {WITH_CONTENT} window w as (partition by conv_id order by turn_index, turn_id)""")
def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.turn_context(turns_once(spark, sf_dir))


@query(f"with {TURNS} select conv_id, count(*) n_turns, count(*) filter ({ROLE} = 'user') n_user, sum(length(content))::bigint n_chars from turns1 where {WITH_CONTENT} group by 1")
def conversation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.totals(turns_once(spark, sf_dir))


@query(f"""with {TURNS} select conv_id, string_agg('### ' || upper(coalesce({ROLE}, 'unknown')) || case when coalesce(trim(timestamp), '') <> '' then ' (' || trim(timestamp) || ')' else '' end
    || chr(10) || chr(10) || trim(content), chr(10) || chr(10) order by turn_index nulls first, turn_id) as text from turns1 where {WITH_CONTENT} group by 1""")
def conversation_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.render(turns_once(spark, sf_dir))


@query()
def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every conversation, with text."""
    return conversations.chunks(turns_once(spark, sf_dir), 512, table(spark, sf_dir, "conversations"))


#: White space as Python's splitting has it.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def ink_sql(column: str) -> str:
    return f"length(regexp_replace({column}, '{SPACE}', '', 'g'))"



def _ink(text: str) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


@query(f"""with {TURNS}, t as (select conv_id, sum({ink_sql("content")}) + sum(3 + length({ROLE.replace("role", "coalesce(role, 'unknown')")})) ink from turns1 where {WITH_CONTENT} and conv_id is not null group by 1),
    c as (select conv_id, min(title) title from conversations group by 1)
    select t.conv_id, (ink + case when trim(coalesce(title, '')) <> '' then 1 + {ink_sql("title")} else 0 end)::bigint ink, false too_large from t left join c using (conv_id)""")
def conversation_chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in the chunks of each conversation, and whether one is above the size: nothing is lost or written twice."""
    return conversation_chunks(spark, sf_dir).groupBy("conv_id").agg(F.sum(_ink("text")).alias("ink"), (F.max("n_tokens") > 512).alias("too_large"))


#: Replies of a model, made of the turns so that every kind of reply occurs: a grade, a confidence, gaps and questions.
REPLY = """case turn_id % 4 when 0 then 'INCORRECT' when 1 then 'Ambiguous' when 2 then 'Correct.' else 'no grade' end || chr(10) || '1. ' || substring(coalesce(content, ''), 1, 60) || chr(10) || '# more' || chr(10)
    || '2) of ' || turn_id || chr(10) || case turn_id % 5 when 0 then 'sure' else 'Confidence: ' || case turn_id % 5 when 1 then '0.25' when 2 then '7' when 3 then '-1' else '0.9' end end || chr(10) || 'GAPS: ' || case turn_id % 3 when 0 then 'None' when 1 then 'n/a' else 'what of ' || conv_id end"""
REPLIES = f"{TURNS}, replies as (select turn_id, {REPLY} reply from turns1)"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_once(spark, sf_dir)
    return turns.select("turn_id", F.expr(REPLY.replace("chr(10)", "'\\n'")).alias("reply"))


@query(f"""with {REPLIES} select case when upper(reply) like '%INCORRECT%' then 'incorrect' when upper(reply) like '%AMBIGUOUS%' then 'ambiguous' when upper(reply) like '%CORRECT%' then 'correct' else 'ambiguous' end grade,
    count(*) n_turns from replies where reply is not null group by 1""")
def graded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).where("reply is not null").groupBy(T.grade(F.col("reply")).alias("grade")).agg(F.count("*").alias("n_turns"))


@query(rf"""with {REPLIES}, x as (select turn_id, reply, regexp_extract_all(reply, '(?im)^[ \t]*CONFIDENCE:[ \t]*(-?[0-9.]+)', 1)[-1] said, trim(regexp_extract_all(reply, '(?im)^[ \t]*GAPS:[ \t]*(.*)$', 1)[-1]) gap,
        list_filter(list_transform(string_split(reply, chr(10)), lambda l: trim(l)), lambda l: l <> '') lines from replies where reply is not null)
    select turn_id, greatest(0, least(1, coalesce(said::double, 0.5)))::double confidence, case when lower(gap) in ('none', 'n/a') then null else gap end gaps,
        array_to_string(list_transform(lines, lambda l: trim(regexp_replace(l, '^\d+[.)]\s*', '')))[1:3], ' / ') questions, upper(string_split(reply, chr(10))[1]) not like '%INVALID%' valid from x""")
def reply_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, gaps, first questions and verdict of every reply."""
    r = F.col("reply")
    return _replies(spark, sf_dir).where("reply is not null").select(
        "turn_id", T.confidence(r).alias("confidence"), T.gaps(r).alias("gaps"), F.array_join(T.numbered_lines(r, 3), " / ").alias("questions"), T.verdict(r).alias("valid")
    )


# Chunkers and vectors.


def _sized_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes_once(spark, sf_dir).join(table(spark, sf_dir, "embedding_config"), "config_id")
    return rows.select("note_id", "content", "chunk_size", "chunk_overlap")


def _folded(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunking.chunk(_sized_notes(spark, sf_dir), "note_id", "content", strategy, F.col("chunk_size"), F.col("chunk_overlap"))

    return run


def _split(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunking.split(_sized_notes(spark, sf_dir), "note_id", "content", strategy, F.col("chunk_size"), F.col("chunk_overlap"), plugs.hashing_embedder())

    return run


QUERIES |= {f"{name}_chunks": _folded(name) for name in chunking.FOLDS}
QUERIES |= {f"{name}_split": _split(name) for name in chunking.STRATEGIES}


@query(rf"""with {NOTES}, w as (select note_id, content, chunk_size from notes1 join embedding_config using (config_id) where content is not null and trim(content, E' \t\r\n') <> ''),
    s as (select unnest(['markdown', 'markdown_semantic', 'obsidian_aware', 'paragraphs', 'semantic', 'structure']) strategy)
    select strategy, note_id, {ink_sql("content")}::bigint ink, case when strategy not in ('markdown', 'structure') then false end too_large from w, s""")
def chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in the chunks of each note by the strategies without overlap, and whether one is above the size where that can't be: nothing is lost or written twice."""
    limits, parts = _sized_notes(spark, sf_dir).select("note_id", "chunk_size"), []
    for name in ("structure", "paragraphs", "obsidian_aware", "markdown_semantic", "semantic", "markdown"):
        cut = (_folded if name in chunking.FOLDS else _split)(name)(spark, sf_dir).select("note_id", "text", "n_tokens").join(limits, "note_id")
        large = F.max(F.col("n_tokens") > F.col("chunk_size")) if name not in ("structure", "markdown") else F.lit(None).cast("boolean")
        parts.append(cut.groupBy("note_id").agg(F.sum(_ink("text")).alias("ink"), large.alias("too_large")).select(F.lit(name).alias("strategy"), "*"))
    return reduce(DataFrame.unionByName, parts)


@query("""with d as (select *, lead(embedding) over (partition by label order by vec_id) nxt from embeddings),
    f as (select label, vec_id, round(1 - list_dot_product(embedding::double[], nxt::double[]), 6) distance from d),
    l as (select label, quantile_cont(distance, 0.95) lim from f group by 1)
    select label, vec_id, distance, coalesce(sum(coalesce((distance > lim)::int, 0)) over (partition by label order by vec_id rows between unbounded preceding and 1 preceding), 0)::bigint segment from f join l using (label)""")
def semantic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.series_breaks(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding")


@query("""with e as (select vec_id, label, unnest(embedding)::double v, generate_subscripts(embedding, 1) pos from embeddings),
    c as (select label, pos, avg(v) m from e group by 1, 2), b as (select vec_id, pos, 0.7 * v + 0.3 * m x from e join c using (label, pos))
    select vec_id, round(max(x) / sqrt(sum(x * x)), 5) largest, round(sum(x) / sqrt(sum(x * x)), 5) total from b group by 1""")
def late_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    each = rows.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centres = each.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centre"))
    blended = rows.join(centres, "label").withColumn("b", chunking.blend(F.col("embedding"), F.col("centre")))
    return blended.select("vec_id", F.round(F.array_max("b"), 5).alias("largest"), F.round(F.aggregate("b", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# Search.


@query(f"with {VECTORS} select * from vec")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir)


@query(f"with {VECTORS} select query_id, id, score, rank, substring(text, 1, 200) || '...' excerpt, source from vec join documents on id = doc_id where rank <= 10")
def search_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.excerpt(F.col("text")).alias("excerpt"), "source")
    return vectors(spark, sf_dir, 10).join(docs, "id").select("query_id", "id", "score", "rank", "excerpt", "source")


@query(f"with {VECTORS} select query_id, id, score, rank from vec where score >= 0.3")
def similarity_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cutoff(vectors(spark, sf_dir), 0.3)


BM25 = f"{NOTES}, {TITLES}, {DOCS}, {bm25_sql('hits', 'docs', 'tq', 20)}"


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(corpus(spark, sf_dir), title_queries(spark, sf_dir), 20)


@query(f"with {BM25} select query_id, id, score, rank from hits")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)


@query(f"""with {BM25}, {VECTORS}, u as (select query_id, id, rank from hits union all select query_id, id, rank from vec),
    s as (select query_id, id, round(sum(1.0 / (60 + rank)), 9)::double score from u group by 1, 2)
    select query_id, id, score, row_number() over (partition by query_id order by score desc, id) rank from s qualify rank <= 10""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion([_bm25(spark, sf_dir), vectors(spark, sf_dir)], 10)


@query(f"""with {BM25}, {TAGGED}, {bm25_sql("more", "docs", "gq", 20)},
    u as (select query_id, id, score, 0 list, rank from hits union all select query_id, id, score, 1, rank from more),
    m as (select query_id, id, max(score) score, min(list * 1000 + rank) seen from u group by 1, 2)
    select query_id, id, score, row_number() over (partition by query_id order by score desc, seen, id) rank from m qualify rank <= 20""")
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.max_merge([_bm25(spark, sf_dir), retrieval.bm25(corpus(spark, sf_dir), tag_queries(spark, sf_dir), 20)], 20)


FEDERATED = f"""{NOTES}, {TITLES}, va as (select doc_id id, text from documents where source_type = 'vault' and doc_id is not null), co as (select doc_id id, text from documents where source_type = 'ai_conversation' and doc_id is not null),
    {bm25_sql("a", "va", "tq", 20)}, {bm25_sql("b", "co", "tq", 20)},
    u as (select query_id, id, round(score, 6) score, 'vault' source, 'vault' source_type, rank seen from a
        union all select query_id, id, round(score * 0.8, 6), 'conversations', 'ai_conversation', 1000 + rank from b),
    fed as (select query_id, id, score, source, source_type, row_number() over (partition by query_id order by score desc, seen, id) rank from u qualify rank <= 10)"""


def _federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = title_queries(spark, sf_dir)
    one = lambda kind: retrieval.bm25(corpus(spark, sf_dir, kind), asked, 20)
    return retrieval.federated_merge({"vault": (one("vault"), 1.0, "vault"), "conversations": (one("ai_conversation"), 0.8, "ai_conversation")}, 10)


@query(f"with {FEDERATED} select * from fed")
def federated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _federated(spark, sf_dir)


@query(f"with {FEDERATED} select query_id, count(*) n_hits, count(*) filter (source_type = 'vault') n_vault, count(*) filter (source_type = 'ai_conversation') n_ai_conversation from fed group by 1")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.source_summary(_federated(spark, sf_dir))


@query("select source_type, count(*) n_accounts, round(avg(weight), 6) mean_weight from accounts group by 1")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "accounts").groupBy("source_type").agg(F.count("*").alias("n_accounts"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query(f"""with {BM25}, qt as (select query_id, list_distinct({TERMS}) q from tq), ct as (select id, {TERMS} c from docs),
    s as (select query_id, id, rank old, round(len(list_intersect(q, c)) / greatest(len(q), 1), 6) score from hits join qt using (query_id) join ct using (id))
    select query_id, id, score, row_number() over (partition by query_id order by score desc, old, id) rank from s qualify rank <= 10""")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank_by_overlap(_bm25(spark, sf_dir), title_queries(spark, sf_dir), corpus(spark, sf_dir), 10)


@query(f"""with {BM25} select query_id, substring(string_agg('[' || rank || '] ' || text, chr(10) || chr(10) order by rank), 1, 8000) context
    from hits join docs using (id) where rank <= 5 and text is not null group by 1""")
def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _bm25(spark, sf_dir).where("rank <= 5")
    return contexts(hits.join(retrieval.hit_texts(hits, corpus(spark, sf_dir)), "id"))


@query("select source_type, list_sort(list(distinct coalesce(source, 'Unknown'))) names from documents group by 1")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source_type").agg(F.array_sort(F.collect_set(F.coalesce("source", F.lit("Unknown")))).alias("names"))


@query("""with k as (select sha256(text) text_key, max(length(text)) n from documents where text is not null group by 1)
    select count(*) n_entries, sum(n)::bigint n_chars, round(sum(n) / 1048576.0::double, 2) mega from k""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").where("text is not null").groupBy(T.cache_key(F.col("text")).alias("text_key")).agg(F.max(F.length("text")).alias("n"))
    return keys.agg(F.count("*").alias("n_entries"), F.sum("n").alias("n_chars"), F.round(F.sum("n") / 1048576.0, 2).alias("mega"))


METRICS = f"""{VECTORS}, rel as (select q.vec_id query_id, c.vec_id id from embeddings q join embeddings c using (label) where q.vec_id % 20 = 0),
    good as (select query_id, count(*) good, min(rank) best, sum(1 / log2(rank + 1)) dcg from vec join rel using (query_id, id) where rank <= 10 group by 1),
    n as (select query_id, count(*) n from rel group by 1),
    m as (select query_id, round(coalesce(good, 0) / 10, 6) "precision", round(coalesce(good, 0) / n, 6) recall, round(coalesce(1 / best, 0), 6) mrr,
        round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) ndcg from n left join good using (query_id))"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"))
    relevant = rows.where("id % 20 = 0").select("label", F.col("id").alias("query_id")).join(rows, "label").select("query_id", "id")
    return retrieval.ranking_metrics(vectors(spark, sf_dir), relevant, 10)


@query(f"with {METRICS} select * from m")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


RANKING, RANK_WEIGHTS = ("ndcg", "mrr", "precision", "recall"), (0.3, 0.3, 0.2, 0.2)


@query(f"""with {METRICS} select count(*) n_cases, round(avg(ndcg), 6) ndcg, round(avg(mrr), 6) mrr, round(avg("precision"), 6) "precision", round(avg(recall), 6) recall,
    round(0.3::double * avg(ndcg) + 0.3::double * avg(mrr) + 0.2::double * avg("precision") + 0.2::double * avg(recall), 6) overall from m""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.report(_metrics(spark, sf_dir), RANKING, RANK_WEIGHTS)


@query(f"""with {METRICS} select * from m where least(ndcg, mrr, "precision", recall) < 0.05""")
def evaluation_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.failed(_metrics(spark, sf_dir), 0.05, RANKING)


# Ledger, caches and incremental loads.

LEDGER = "once as (select usage_id, max(ledger) ledger, max(model) model, max(tokens_used) tokens_used, max(token_limit) token_limit, max(requests_count) requests_count from usage_ledger where usage_id is not null group by 1)"
USAGE = f"""{LEDGER}, g as (select ledger, lower(trim(model)) model, sum(coalesce(tokens_used, 0))::bigint tokens_used, max(coalesce(token_limit, 0)) token_limit, sum(coalesce(requests_count, 0))::bigint requests from once group by 1, 2),
    u as (select *, greatest(0, token_limit - tokens_used) remaining, round(case when token_limit = 0 then 100.0::double else tokens_used * 100.0::double / token_limit end, 6) percent_used, tokens_used >= token_limit exhausted from g)"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("ledger", "model", "tokens_used", "token_limit", "requests_count")
    once = table(spark, sf_dir, "usage_ledger").where("usage_id is not null").groupBy("usage_id").agg(*[F.max(c).alias(c) for c in columns])
    return ledger.usage_totals(once, _model())


def _model() -> Column:
    return F.lower(F.trim("model"))


@query(f"with {USAGE} select * from u")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir)


@query(f"""with {USAGE} select ledger, model, case when exhausted or tokens_used + 1000 > token_limit then 'refuse' when (tokens_used + 1000) * 100.0::double > token_limit * 90.0::double then 'warn' else 'accept' end decision from u""")
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.quota(_usage(spark, sf_dir), F.lit(1000)).select("ledger", "model", "decision")


@query("""with l as (select user_id, max(event_id) last_seq from events where user_id is not null group by 1 order by 2 desc, 1 limit 100)
    select *, row_number() over (order by last_seq desc, user_id) "position" from l""")
def lru_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.lru_contents(table(spark, sf_dir, "events"), "user_id", "event_id", 100)


@query(f"with {NOTES}, c as (select distinct sha256(text) text_key from documents where text is not null) select note_id, sha256(content) text_key, sha256(content) in (select text_key from c) and content is not null hit from notes1")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "documents").select(T.cache_key(F.col("text")).alias("text_key"))
    return ledger.cache_lookup(notes_once(spark, sf_dir).select("note_id", "content"), cache, "content").select("note_id", "text_key", "hit")


@query("select doc_id, source_type from documents d where not exists (select 1 from subject_labels s where s.doc_id = d.doc_id)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.not_processed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), "doc_id").select("doc_id", "source_type")


@query(f"""with {NOTES}, old as (select note_id, case when note_id % 7 = 0 then upper(content) else content end content from notes1 where ingested_at < timestamp '2025-06-01'),
    new as (select note_id, content from notes1 where note_id % 11 <> 0)
    select coalesce(new.note_id, old.note_id) note_id, case when old.note_id is null then 'new' when new.note_id is null then 'deleted' else 'changed' end change
    from new full join old on new.note_id = old.note_id where old.note_id is null or new.note_id is null or coalesce(old.content, '') <> coalesce(new.content, '')""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against an earlier load, in which some notes were other and from which some are gone since."""
    notes = notes_once(spark, sf_dir)
    old = notes.where("ingested_at < timestamp '2025-06-01 00:00:00 UTC'").withColumn("content", F.expr("case when note_id % 7 = 0 then upper(content) else content end"))
    return ledger.changes(old, notes.where("note_id % 11 <> 0"), "note_id", "content")
