"""The numbered queries over the test tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import decontaminate, html_text, merkle, mixing, near_duplicates, periodic_runs, pii, quality_rules, relative_lz, token_counts, token_ids, toxicity, warc
from stratapanel.llm.common import cut, let, new_folder, remove_folder, table, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@_query
def op1_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_terms"),
    )


@_query
def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archives")
    manifest = warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    records = warc.read_archives(manifest, folder, payloads=False)
    result = cut(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove_folder(spark, folder)
    return result


@_query
def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.score_toxicity(spark, docs, labels)


@_query
def op4_html_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@_query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op6_source_mix"] = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (strlen(coalesce(text, '')) - strlen(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g'))) as symbols
  from documents),
keyed as (
  select *, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':20'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
            / (case when size + 4 * symbols = 0 then 0.5 else (case when size >= 50 then 1.0 else 0.5 end) * (size::double / (size + 4 * symbols)) end) as key
  from sized),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
placed as (select *, row_number() over (order by source nulls last) as place from sources),
weighed as (select *, ((place - 1) % 3 + 1)::bigint as weight, 3 * source_size as most from placed),
filled as (
  select *, sum(source_size) over () - coalesce(sum(most) over (order by most / weight, place rows between unbounded preceding and 1 preceding), 0) as remaining,
         sum(weight) over (order by most / weight, place rows between current row and unbounded following) as weights
  from weighed),
border as (select most / weight as ratio, place, remaining, weights from filled where remaining * weight < most * weights order by most / weight, place limit 1),
targets as (
  select f.source, f.source_size,
         case when b.place is null or (f.most / f.weight, f.place) < (b.ratio, b.place) then f.most::double
              else (b.remaining * f.weight)::double / b.weights::double end as target
  from filled f left join border b on true),
epochs as (select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as epochs from targets),
running as (
  select k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as budget,
         sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows unbounded preceding) as upto
  from keyed k join epochs e on k.source is not distinct from e.source)
select doc_id, size, source_size, target,
       (size * (epochs + case when epochs < 3 and budget > 0 and (upto <= budget or (upto - size < budget and upto - budget < budget - (upto - size))) then 1 else 0 end))::bigint as taken
from running
"""


@_query
def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    verdict = quality_rules.verdicts(entries, quality_rules.BASE, quality_rules.PRODUCTION)
    return verdict.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("kept_base")).alias("base_failed"), F.col(f"kept_{quality_rules.PRODUCTION.version}").alias("kept"), "bits",
    )


ORACLES["op7_quality_ledger"] = r"""
with split as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
         row_number() over () as row
  from documents),
windows as (
  select row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as win
  from (select row, w, unnest(range(1, len(w) - 1)) as i from split where len(w) >= 3)),
repeated as (select row, i from (select row, i, count(*) over (partition by row, win) as n from windows) where n > 1),
covered as (select row, count(distinct i + d) as n from repeated, (values (0), (1), (2)) as steps(d) group by row),
measured as (
  select s.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
         (length(text) - length(replace(text, '!', '')))::bigint as n_exclamations,
         len(regexp_extract_all(text, '\p{Lu}{3,}'))::bigint as n_capitals
  from split s left join covered c using (row)),
judged as (
  select *, case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
          + case when 10 * n_symbols > 3 * n_words then 4 else 0 end + case when 10 * n_exclamations > 5 * n_words then 8 else 0 end
          + case when 100 * n_capitals > 50 * n_words then 16 else 0 end
          + case when 100 * n_dup_lines > 50 * n_lines and n_dup_lines >= 3 then 32 else 0 end
          + case when word_chars > 14 * n_words then 64 else 0 end + case when 10 * word_chars < 22 * n_words then 128 else 0 end as bits
  from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 as base_failed,
       (bits & 47) = 0 and bit_count((bits & 208)::bigint) <= 1 as kept, bits::bigint as bits
from judged
"""


@_query
def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@_query
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-ids")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = token_ids.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    result = cut(token_ids.read_token_files(manifest, folder))
    remove_folder(spark, folder)
    return result


@_query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def _id_hash(doc_id: Column) -> Column:
    """Unsigned CRC-32 of an id written in decimal."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the hash of its id, repeats a stretch of its words from some word on."""
    seed = F.floor(_id_hash(F.col("doc_id")) / 10)

    def altered(w: Column) -> Column:
        n = F.size(w)
        a = seed % n
        p = 1 + F.floor((n - a) / (3 + seed % 8))
        taken = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(taken, " "))

    planted = F.when(_id_hash(F.col("doc_id")) % 10 == 0, let(words(F.col("text")), altered)).otherwise(F.col("text"))
    return docs.select("doc_id", planted.alias("text"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_with_planted_periods(table(spark, sf_dir, "documents", "doc_id", "text")))
    first = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (("start", 0), ("length", 0), ("period", 1))])
    # Runs come by start, then period: of equal exponents the first stays.
    best = F.aggregate("runs", first, lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), spelled.alias("spelled"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("spelled"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    head, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(_id_hash(F.col("doc_id")) % 5 == 0, merkle.leaf_digest(*head, lowered))
    leaves = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").alias("group"), merkle.leaf_digest(*head, text).alias("digest"), tampered.alias("presented"))
    rows = merkle.manifest(leaves).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLES["op12_merkle_manifest"] = r"""
with recursive spelled as (
  select doc_id, coalesce('s' || source, '-') as grp,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
         coalesce(strlen(text) || ':' || text, '-') as body,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
             lambda a, x: list_reduce(list_concat([xor(a, x)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) as crc
  from documents),
hashed as (
  select doc_id, grp, sha256(head || body) as leaf,
         case when crc % 5 = 0 then sha256(head || translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) end as presented
  from spelled),
leaves as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as place, row_number() over () as row from hashed),
nodes as (
  select grp, 0 as level, place as idx, leaf as digest, count(*) over (partition by grp) as n from leaves
  union all
  select grp, level + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 15) // 16 from nodes where n > 1 group by grp, level, idx // 16),
subroots as (select grp, digest, row_number() over (order by nullif(grp, '-') nulls first) - 1 as place, count(*) over () as n from nodes where n = 1),
top as (
  select 0 as level, place as idx, digest, n from subroots
  union all
  select level + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 15) // 16 from top where n > 1 group by level, idx // 16),
all_nodes as (select grp, level, idx, digest from nodes where n > 1 union all select null, level + 100, idx, digest from top where n > 1),
beside as (
  select grp, level, idx,
         coalesce(string_agg(digest, '') over (partition by grp, level, idx // 16 order by idx rows between unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(digest, '') over (partition by grp, level, idx // 16 order by idx rows between 1 following and unbounded following), '') as r
  from all_nodes),
steps as (
  select row, row_number() over (partition by row order by level) as step, l, r
  from (select v.row, b.level, b.l, b.r from leaves v join beside b on b.grp = v.grp and b.idx = v.place >> (4 * b.level)
        union all
        select v.row, b.level, b.l, b.r from leaves v join subroots s on s.grp = v.grp join beside b on b.grp is null and b.idx = s.place >> (4 * (b.level - 100)))),
folded as (
  select row, 0::bigint as step, coalesce(presented, leaf) as digest from leaves
  union all
  select f.row, f.step + 1, sha256(s.l || f.digest || s.r) from folded f join steps s on s.row = f.row and s.step = f.step + 1),
proofs as (select row, sha256(string_agg(l || r, '' order by step)) as proof_sha256 from steps group by row)
select v.doc_id, v.leaf, s.digest as subroot, t.digest as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.digest as folded_root, f.digest = t.digest as verified
from leaves v join subroots s using (grp) join (select digest from top where n = 1) t on true left join proofs p using (row)
join (select row, arg_max(digest, step) as digest from folded group by row) f using (row)
"""


@_query
def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = relative_lz.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op13_repeated_passages"] = r"""
with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, row_number() over () as row from documents),
windows as (
  select row, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as win
  from (select row, doc_id, w, unnest(range(1, len(w) - 48)) as i from split where len(w) >= 50)),
late as (select row, i from (select row, doc_id, i, min(doc_id) over (partition by win) as first from windows) where first < doc_id),
covered as (select row, i + d as i from late, range(50) as steps(d) group by row, i + d),
gone as (select row, count(*) as n from covered group by row),
kept as (
  select s.row, string_agg(s.word, ' ' order by s.i) as words
  from (select row, unnest(w) as word, generate_subscripts(w, 1) as i from split where row in (select row from gone)) s
  left join covered c on c.row = s.row and c.i = s.i where c.row is null group by s.row)
select s.doc_id, len(w)::bigint as n_words, coalesce(g.n, 0)::bigint as n_removed,
       sha256(case when g.n is null then array_to_string(w, ' ') else coalesce(k.words, '') end) as kept_sha256
from split s left join gone g using (row) left join kept k using (row)
"""
