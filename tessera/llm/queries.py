"""One query for each corpus operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, linededup, media, mixing, pages, phrases, pii, simhash, toxicity, warc, whitening

VOCABULARY = "word_bpe_49k.json"
#: What op4 adds to the conversations: texts that look like a template's control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        (F.col("size") * F.size("times")).alias("taken"),
        F.size("times").alias("copies"),
        F.get("times", F.lit(0)).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("tessera.pii.key", "a key for tests only")
    return pii.replace_entities(table(spark, sf_dir, "documents"), key).select("doc_id", "n_entities", "text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    made = chat.format_windows(turns.unionByName(extra), budget=256, history_budget=64)
    own = F.flatten(F.transform("windows", chat.read_turns))
    said = F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("windows", chat.read_loss), "")
    return made.select(
        "conv_id",
        F.size(own).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.aggregate(
            F.transform("windows", lambda w: F.length(chat.read_loss(w))), F.lit(0).cast("long"), lambda acc, n: acc + n
        ).alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w["text"])).alias("formatted_chars"),
        F.size("windows").alias("n_windows"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.wrap(table(spark, sf_dir, "documents").select("doc_id", "text"))
    seen = media.probe(stored)
    ends = F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["length"]))
    return seen.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        F.concat_ws(
            ";", F.trim("codec"), F.format_string("%.6f", "duration_s"), F.size("keyframes").cast("string"), F.sha2(F.array_join(ends, ","), 256)
        ).alias("feature"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.drop_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_chunks", "n_removed", "removed_lines", "text")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = white.select("vec_id", "n", F.expr("try_cast(deviation as long)").alias("deviation"), "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error"
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = pages.extract(table(spark, sf_dir, "pages"))
    return main.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_surrogates, op3_bpe, op4_chat, op5_simhash, op6_media, op7_line_dedup, op8_embedding_dedup, op9_warc, op10_toxicity,
        op11_whitening, op12_phrases, op13_page_text,
    )
}

ORACLE_SQL = {
    "op1_mixing": r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(concat('mix|', coalesce(doc_id::varchar, 'null'))) as digest
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, encode(coalesce(source, ''))) - 1 as rk
  from sized group by source),
weighed as (
  select *, [5.0, 2.0, 1.0][(rk % 3 + 1)::int]::double as weight, [1.5, 1.0, 0.5][(rk % 3 + 1)::int]::double as a, [0.5, 1.0, 1.5][(rk % 3 + 1)::int]::double as b from sources),
levels as (
  select *, (sum(source_size) over () - 3.0::double * coalesce(sum(source_size) over f, 0)) / (sum(weight) over () - coalesce(sum(weight) over f, 0)) as lvl
  from weighed window f as (order by source_size / weight, rk rows between unbounded preceding and 1 preceding)),
held as (
  select *, (select lvl from levels where not (lvl * weight >= 3.0::double * source_size) order by source_size / weight, rk limit 1) as open_lvl from levels),
targets as (
  select source, source_size, weight * a as w0, weight * b as w1,
         case when lvl * weight >= 3.0::double * source_size then 3.0::double * source_size else open_lvl * weight end as target
  from held),
laid as (
  select d.doc_id, d.size, t.source_size, t.target, t.w0, t.w1,
         coalesce(sum(d.size) over (partition by d.source order by ('0x' || substr(digest, 1, 8))::bigint % 1024, digest, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sized d join targets t on d.source is not distinct from t.source),
counted as (
  select *, case when source_size > 0 then (start + size / 2.0::double < target)::int + (source_size + start + size / 2.0::double < target)::int + (2 * source_size + start + size / 2.0::double < target)::int else 0 end as copies,
         (start + size / 2.0::double) / target as share, (w0 + w1) / 2 as whole, w1 - w0 as slope
  from laid)
select doc_id, size, source_size, target, size * copies as taken, copies,
       case when copies = 0 then null when slope = 0 then share else 2 * share * whole / (w0 + sqrt(w0 * w0 + 2 * slope * share * whole)) end as position
from counted
""",
    "op4_chat": r"""
with recursive said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed as (
  select *, dense_rank() over (order by conv_id nulls first) as c, row_number() over (partition by conv_id order by turn nulls first, encode(role), encode(text)) as i,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 as cost,
         length(replace(replace(role, '\', '\\'), '|', '\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|' || '|>' || '<|end|>') + 2 as written
  from said),
summed as (select *, sum(cost) over (partition by c order by i)::bigint as upto from placed),
conv as (
  select c, any_value(conv_id) as conv_id, count(*)::bigint as n, (min_by(role, i) = 'system')::int::bigint as h, [0::bigint] || list(upto order by i) as upto, list(written order by i) as written,
         string_agg(role || chr(10) || text || chr(10), '' order by i) as turns, coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '') as learnt
  from summed group by c),
-- i: turns before this one; back: turns repeated where a window starts with it, else null
state as (
  select c, h as i, h * upto[2] + upto[h + 2] - upto[h + 1] as used, 0::bigint as back from conv where n > h
  union all
  select s.c, s.i + 1,
         case when s.used + upto[s.i + 3] - upto[s.i + 2] <= 256 then s.used + upto[s.i + 3] - upto[s.i + 2] else h * upto[2] + upto[s.i + 3] - upto[s.i + 2 - b.k] end,
         case when s.used + upto[s.i + 3] - upto[s.i + 2] > 256 then b.k end
  from state s join conv using (c),
    lateral (select list_max(list_filter([0, 1, 2]::bigint[], lambda k: k = 0 or (k <= s.i + 1 - h and upto[s.i + 2] - upto[s.i + 2 - k] <= 64 and h * upto[2] + upto[s.i + 3] - upto[s.i + 2 - k] <= 256))) as k) b
  where s.i + 1 < n),
windows as (
  select c, count(*) as n_windows, sum(coalesce(list_sum(written[i - back + 1:i]), 0))::bigint as repeated from state join conv using (c) where back is not null group by c)
select conv_id, n as n_turns, sha256(turns) as turns_sha256, length(learnt)::bigint as loss_chars, sha256(learnt) as loss_sha256,
       (coalesce(list_sum(written[h + 1:n]), 0) + coalesce(n_windows, 1) * h * written[1] + coalesce(repeated, 0))::bigint as formatted_chars, coalesce(n_windows, 1)::int as n_windows
from conv left join windows using (c)
""",
    "op7_line_dedup": r"""
with docs as (select doc_id, text, md5(text) as k from documents),
uniq as (select distinct doc_id, k, text from docs where text is not null and text <> ''),
written as (select doc_id, k, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as li from uniq),
beside as (
  select *, coalesce(length(line) >= 200, false) or coalesce(length(lead(line) over w) >= 200, false) as apart, lead(li) over w is null as final
  from written window w as (partition by doc_id, k order by li)),
whole as (select *, case when final then line else line || chr(10) end as full_line from beside),
pieces as (
  select doc_id, k, li, apart, list_filter(string_split(regexp_replace(full_line, '([.!?] )', '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') as ps from whole),
placed as (select doc_id, k, li, apart, unnest(ps) as t, generate_subscripts(ps, 1) as j, len(ps) as m from pieces),
lines as (select *, row_number() over (partition by doc_id, k order by li, j) as i, apart and j = m as stop, rtrim(t, ' ' || chr(10)) as bare from placed),
hashed as (select *, ('0x' || substr(md5(bare), 1, 15))::bigint as h from lines),
rolled as (
  select *, (case when lag(stop) over w then 0 else coalesce(lag(h) over w % 1000003, 0) end * 31 + h % 1000003) % 1000003 as r, count(*) over (partition by doc_id, k) as total
  from hashed window w as (partition by doc_id, k order by i)),
cut as (select *, coalesce(sum(((r % 3 = 0 or stop) and i < total)::int) over (partition by doc_id, k order by i rows between unbounded preceding and 1 preceding), 0) as c from rolled),
chunks as (select doc_id, k, c, count(*) as n, string_agg(bare, chr(10) order by i) as txt, string_agg(t, '' order by i) as whole from cut group by doc_id, k, c),
ranked as (select doc_id, k, c, row_number() over (partition by txt order by doc_id is null, doc_id, k, c) > 1 as again from chunks where n > 1 or length(txt) >= 10),
known as (select c.*, coalesce(r.again, false) as again from chunks c left join ranked r on c.doc_id is not distinct from r.doc_id and c.k = r.k and c.c = r.c),
decided as (
  select *, again and (n > 1 or length(txt) >= 200 or coalesce(lag(again) over w, false) or coalesce(lead(again) over w, false)) as gone
  from known window w as (partition by doc_id, k order by c)),
per_doc as (
  select doc_id, k, count(*) as n_chunks, sum(gone::int) as n_removed, coalesce(sum(n) filter (gone), 0) as removed_lines, string_agg(case when not gone then whole end, '' order by c) as kept
  from decided group by doc_id, k)
select d.doc_id, coalesce(n_chunks, 0)::int as n_chunks, coalesce(n_removed, 0)::int as n_removed, coalesce(removed_lines, 0)::int as removed_lines,
       case when n_removed is null or n_removed = 0 then d.text else coalesce(kept, '') end as text
from docs d left join per_doc p on d.doc_id is not distinct from p.doc_id and d.k = p.k
""",
    "op8_embedding_dedup": r"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as u, b.vec_id as w from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(u, w) as (select vec_id, vec_id from embeddings union select r.u, l.w from reach r join links l on r.w = l.u),
roots as (select u as vec_id, min(w) as component_id from reach group by u)
select e.vec_id, (select count(*) from links where u = e.vec_id) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join roots using (vec_id)
""",
    "op9_warc": r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by html) as first_id from p)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * k + 1)::int, 5))::bigint >> s) & 31) + 1)::int, 1)), '')), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from f
""",
    "op12_phrases": r"""
with docs as (
  select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
split as (select d, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') as ps from docs),
pieces as (select lang, d, unnest(ps) as piece, generate_subscripts(ps, 1) as p from split),
cut as (select lang, d, p, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
spelt as (select lang, d, p, unnest(ws) as w1, generate_subscripts(ws, 1) as i from cut),
runs as (select lang, w1, lead(w1, 1) over s as w2, lead(w1, 2) over s as w3 from spelt window s as (partition by lang, d, p order by i)),
one as (select lang, w1, count(*) as f from runs group by all),
two as (select lang, w1, w2, count(*) as f from runs where w2 is not null group by all having count(*) >= 10),
three as (select lang, w1, w2, w3, count(*) as f from runs where w3 is not null group by all having count(*) >= 10),
longer as (select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from three union all select lang, w2, w3, f from three) group by all),
cuts as (
  select t.lang, t.w1 || ' ' || t.w2 as phrase, t.f as a, 1 as k, x.f as l, y.f as r
  from two t join one x on x.lang = t.lang and x.w1 = t.w1 join one y on y.lang = t.lang and y.w1 = t.w2 left join longer g on g.lang = t.lang and g.w1 = t.w1 and g.w2 = t.w2
  where g.f is null or 100 * g.f < 50 * t.f
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  from three t join one x on x.lang = t.lang and x.w1 = t.w1 join two y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  from three t join two x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join one y on y.lang = t.lang and y.w1 = t.w3),
scored as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from lowest),
totals as (select lang, sum(f)::bigint as n from one group by lang)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
""",
}
