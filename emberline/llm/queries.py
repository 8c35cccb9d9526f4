"""The registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import bpe, chat, decontam, katz, licenses, lines, omh, pii, rans, sketches, spelling, toxicity, trie
from emberline.llm.common import read, text_of, written

#: The key of surrogates in the query; a user passes a secret of their own.
PII_KEY = "query-key"
#: Tokenizer files by their path, which is a parameter of the operators.
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data: doc_id, text, n_entities."""
    return pii.pseudonymized(read(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    ids = read(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), BYTE_BPE, public_tokenizers.PATTERN).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(F.col("ids"), BYTE_BPE, public_tokenizers.PATTERN).alias("decoded"))
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, read back from the formatted examples: turns, loss text, characters."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    examples = chat.expand(turns.union(extra))
    turn = F.transform(chat.parsed(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.when(F.col("trainable"), chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end"))).otherwise("")
    # a conversation's longest example, its last, holds all its turns
    last = F.lead("example").over(_by_conversation()).isNull()
    each = examples.select("conv_id", "example", F.length("text").alias("chars"), loss.alias("loss"), F.when(last, turn).alias("turns"))
    whole = each.groupBy("conv_id").agg(F.max(F.size("turns")).cast("bigint").alias("n_turns"), F.max(F.array_join("turns", "")).alias("turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _by_conversation():
    from pyspark.sql.window import Window

    return Window.partitionBy("conv_id").orderBy("example")


def op4_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    docs = read(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    rows = sketches.followed(docs)
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.substr("next", F.lit(1), F.floor(n / 4).cast("int")))
    kept = rows.select("doc_id", "text", "next", edited.alias("edited")).select("*", *[sketches.sketch(F.col(c)).alias(f"{c}_sketch") for c in ("text", "edited", "next")])
    prints = kept.select("*", *[sketches.fingerprint(F.col(c), F.col(f"{c}_sketch")).alias(f"{c}_print") for c in ("text", "edited", "next")])
    near = lambda c: sketches.likeness(F.col("text_sketch"), F.col(f"{c}_sketch"), F.col("text_print"), F.col(f"{c}_print"))
    return prints.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("text_print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"), near("edited").alias("near_edited"), near("next").alias("near_next"))


def op5_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written in interleaved blocks and read back."""
    return rans.round_trip(read(spark, sf_dir, "documents"), WORD_BPE)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document, with their spans in the original text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.judged(decontam.contamination(docs, read(spark, sf_dir, "benchmark")))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of documents, whose path is source/lang/doc_id."""
    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("id"), "text")
    return licenses.scanned(files).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")).score(docs)
    return scored.select("doc_id", (~toxicity.trains(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes: one row a document with its class and the links of its representative."""
    return omh.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated lines: doc_id, text, n_lines, n_kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    return lines.deduplicated(docs, exact_words=1).withColumn("n_kept", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations, each rebuilt with the first turns of the first of its twenty."""
    turns = written(trie.ordered(read(spark, sf_dir, "conversations")))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(20))).alias("base")
    every = turns.select("conv_id").distinct()
    heads = turns.where("depth <= 3").where(F.pmod("conv_id", F.lit(20)) == 0).select(F.col("conv_id").alias("base"), "depth", "role", "text")
    sized = heads.groupBy("base").agg(F.count("*").alias("size"))
    convs = every.select("conv_id", base, h.alias("h")).join(sized, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("taken"))
    shared = convs.join(heads, "base").where("depth <= h").select("conv_id", "depth", "role", "text")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).cast("int").alias("depth"), "role", "text")
    return trie.prefix_trie(shared.union(own), every).drop("node")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their near words' number, the form they are a variant of, and where forms end."""
    return spelling.variant_groups(spelling.word_counts(read(spark, sf_dir, "documents"), noise=31))


def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every text by an n-gram model learnt from the texts that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1).alias("held_out"))
    scored = katz.fit_score(docs.withColumn("train", ~F.col("held_out"))).scores
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '(<|\[|<<)(/?(?:s>|INST\]|SYS>>)|\|)', '\1\\\2', 'g')"

#: crc32 of a list of bytes in SQL: a table of 256 sums, then one look-up a byte.
_CRC = "crc as (select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda x, i: xor(x >> 1, case when x % 2 = 1 then 3988292384 else 0 end))) as t)"
_CRC32 = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(hex(encode({0}))), 2), lambda i: cast('0x' || substr(hex(encode({0})), i, 2) as bigint))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"

SQL = {
    "op11_prefix_trie": rf"""
with {_CRC},
t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 20 as base, {_CRC32.format('conv_id::varchar')} % 4 as h from (select distinct conv_id from t), crc),
shared as (select c.conv_id, t.p, t.role, t.text from c join t on t.conv_id = c.base where t.p <= c.h),
taken as (select conv_id, count(*) as k from shared group by conv_id),
turns as (
  select * from shared union all
  select c.conv_id, t.p - c.h + coalesce(k, 0), t.role, t.text from c join t using (conv_id) left join taken using (conv_id) where t.p > c.h),
paths as (
  select conv_id, p as depth, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' order by p) over w) as node,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as words
  from turns window w as (partition by conv_id order by p rows unbounded preceding)
  union all select conv_id, 0, 'root', 0 from c),
nodes as (select depth, node, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words from paths group by depth, node),
linked as (
  select n.*, up.node as parent, above.conv_id as parent_conv_id
  from nodes n left join paths up on up.conv_id = n.conv_id and up.depth = n.depth - 1 left join nodes above on above.depth = up.depth and above.node = up.node),
children as (select depth - 1 as depth, parent as node, count(*) as n_children from linked where parent is not null group by 1, 2),
sized as (select l.*, coalesce(n_children, 0) as n_children from linked l left join children using (depth, node)),
sums as (
  select up.depth, up.node, count(*) filter (where n_children = 0) as n_leaves, sum((s.n_convs - 1) * s.words) as saved_tokens
  from sized s join paths up on up.conv_id = s.conv_id and up.depth <= s.depth group by 1, 2),
ends as (select depth, node, string_agg(conv_id::varchar, ',' order by conv_id) as ids from (select conv_id, max(depth) as depth from paths group by conv_id) join paths using (conv_id, depth) group by 1, 2)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from sized join sums using (depth, node) left join ends using (depth, node)""",
    "op12_spelling_variants": rf"""
with recursive {_CRC},
runs as (
  select id, run, count(*) as c from (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents)
  where length(run) >= 7 group by id, run),
hashed as (select run, c, {_CRC32.format("(id || ':' || run)")} as h from runs, crc),
noisy as (select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from hashed),
words as (select word, cast(sum(c) as bigint) as n from noisy where length(word) >= 7 group by word having sum(c) >= 2),
cuts as (select word, left(word, i) || '|' || substr(word, i + 2) as pattern, left(word, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from words)),
near as (
  select a.word, b.word as near from cuts a join cuts b using (pattern) where a.word <> b.word
  union select c.word, w.word from cuts c join words w on w.word = c.rest
  union select w.word, c.word from cuts c join words w on w.word = c.rest),
best as (select near.word, count(*) as n_near, arg_max(near, (w.n, -r)) as form, max(w.n) as form_n
  from near join (select *, row_number() over (order by word) as r from words) w on w.word = near.near group by near.word),
formed as (select word, n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * n then form end as form, case when form_n >= 10 * n then form_n end as form_n from words left join best using (word)),
steps as (select word, form as root from formed where form is not null
  union all select s.word, f.form from steps s join formed f on f.word = s.root where f.form is not null),
ends as (select s.word, s.root from steps s join formed f on f.word = s.root where f.form is null)
select word, form, coalesce(root, word) as root, n, n_near, form_n from formed left join ends using (word)""",
    "op3_chat_prefix_target": rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role = 'assistant' as reply from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', false
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', true),
sized as (
  select *, 8 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) as chars,
    row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1 as final from t),
sums as (select *, sum(chars) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto from sized)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where reply), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where reply), '')) as loss_sha256,
  cast(sum(upto) filter (where reply or final) as bigint) as formatted_chars
from sums group by conv_id""",
    "op6_decontamination": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
win as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(list_slice(w, p, p + 12), ' ') as phrase
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as p from i where len(w) > 0)),
lens as (select distinct n from win),
grams as (
  select doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as phrase
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, lens where len(w) >= n)),
found as (select g.doc_id, g.n, g.p, win.item_id from grams g join win on g.n = win.n and g.phrase = win.phrase),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from found) group by doc_id),
who as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join who using (doc_id)""",
}


def queries() -> dict:
    ops = (op1_pii_surrogates, op2_byte_bpe, op3_chat_prefix_target, op4_scaled_sketches, op5_rans_tokens, op6_decontamination, op7_license_scan, op8_toxicity, op9_near_duplicates, op10_fuzzy_lines, op11_prefix_trie, op12_spelling_variants, op13_katz_scores, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
