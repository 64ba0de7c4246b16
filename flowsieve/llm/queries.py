"""Registered queries, one per operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

import public_tokenizers

from flowsieve.llm.bpe import Tokenizer
from flowsieve.llm.decontaminate import contamination
from flowsieve.llm import langid, lm, trie
from flowsieve.llm.exact import incremental_groups
from flowsieve.llm.html import main_text
from flowsieve.llm.mixing import mixed
from flowsieve.llm.near import near_classes
from flowsieve.llm.pii import pseudonymized
from flowsieve.llm.registry import query, table
from flowsieve.llm.runs import longest_run, periodic_runs
from flowsieve.llm.secrets import addressed, findings_by_row, scan_increments
from flowsieve.llm.sharding import sharded
from flowsieve.operators.skew import lookup_join
from flowsieve.runtime import stage

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""with d as (select row_number() over () as rid, doc_id, coalesce({_WORDS}, []) as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
iw as (select item_id, l, array_to_string(w[s:s + l - 1], ' ') as k
 from (select item_id, w, least(10, len(w)) as l, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0)),
dw as (select rid, s, l, array_to_string(w[s:s + l - 1], ' ') as k
 from (select rid, w, l, unnest(range(1, len(w) - l + 2)) as s from d, (select distinct l from iw) where len(w) >= l)),
hit as (select distinct rid, s, l, item_id from dw join iw using (l, k)),
covered as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(s, s + l)) as p from hit) group by rid),
named as (select rid, count(*) as n_items, string_agg(id, ',' order by id) as ids
 from (select distinct rid, cast(item_id as varchar) as id from hit) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (rid) left join named using (rid)""")
def op1_decontaminate(spark, sf_dir):
    """Words of every document inside a 10-word window of the benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op5_kd_shards(spark, sf_dir):
    """All documents in eight shards of near equal bytes, split along their metadata."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    found = sharded(docs, ["doc_id", "text_crc32"], ["source", "lang", "n_chars", "doc_id"], shards=8)
    return found.select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query(r"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w,
 1.5::double * sum(source_size) over () as total from s),
f as (select *, (total - coalesce(sum(2 * source_size) over (o rows between unbounded preceding and 1 preceding), 0)) * w
 > cast(2 * source_size as double) * sum(w) over (o rows between current row and unbounded following) as is_full
 from w window o as (order by source_size / w, source nulls last)),
t as (select source, source_size, case when is_full then cast(2 * source_size as double) else
 (total - coalesce(sum(case when is_full then 2 * source_size end) over (), 0)) * w / sum(case when not is_full then w end) over () end as target from f),
c as (select doc_id, size, source_size, target, floor(round(target / source_size, 9)) as whole,
 sum(size) over (partition by d.source order by md5(coalesce(cast(doc_id as varchar), ''))[1:15] rows unbounded preceding) as upto
 from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(size * least(2, whole + case when upto <= target - whole * source_size then 1 else 0 end) as bigint) as taken from c""")
def op9_mix(spark, sf_dir):
    """Words of every document in a mixture of the sources to target weights."""
    found = mixed(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


@query("""with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)""")
def op4_exact(spark, sf_dir):
    """Groups of documents with equal texts: even ids come after odd ones and are looked up in a perfect hash of those."""
    return incremental_groups(table(spark, sf_dir, "documents"), 1 - F.pmod("doc_id", F.lit(2)), 2)


@query()
def op10_langid(spark, sf_dir):
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))).withColumn("key", F.col("doc_id").cast("string")))
    found = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"),
                        langid.language(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def _secret_sql(name: str, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""select rid, '{name}' as kind, upto - size as s, upto as e from (
 select rid, i, len(whole) as size, ok, sum(len(gap) + len(whole)) over (partition by rid order by i) as upto from (
 select rid, unnest(range(1, len(m) + 1)) as i, unnest(m) as whole, unnest(p[1:len(m)]) as gap, unnest(list_transform(g, lambda x: len(x) >= {least})) as ok from (
 select rid, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {group}) as g,
 regexp_split_to_array(text, '{pattern}') as p from d)) ) where ok"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@query(f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
f as ({_secret_sql("assign", _ASSIGN, 2, 8)} union all {_secret_sql("access", "AKIA[A-Z0-9]+", 0, 16)} union all {_secret_sql("hex", "[0-9a-f]+", 0, 32)}),
a as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
 string_agg(kind || ':' || s || ':' || e, ',' order by s, case kind when 'assign' then 0 when 'access' then 1 else 2 end) as spans from f group by rid)
select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access,
cast(coalesce(n_hex, 0) as bigint) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (rid)""")
def op7_secrets(spark, sf_dir):
    """Secrets in every document: even ids come after odd ones, and of those only texts that the ledger lacks are scanned."""
    rows = addressed(table(spark, sf_dir, "documents"), ["doc_id"])
    _, findings = scan_increments(rows, 1 - F.pmod("doc_id", F.lit(2)), 2)
    found = findings_by_row(rows, findings, ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


@query(r"""with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer|$)', 1) as x from pages),
b as (select page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') as x from a),
c as (select page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as text from b)
select page_id, url, text, cast(length(text) as bigint) as n_chars from c""")
def op8_html(spark, sf_dir):
    """Main text of every page. The oracle knows the one layout of these pages, the query does not."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


@query()
def op2_pseudo_likelihood(spark, sf_dir):
    """Pseudo-log-likelihood of every document under a network trained on all of them."""
    return lm.scored(table(spark, sf_dir, "documents"), ["doc_id"])


@query()
def op3_surrogates(spark, sf_dir):
    """Every document with its personal data replaced by surrogates."""
    return pseudonymized(table(spark, sf_dir, "documents"), "the key of this run", ["doc_id"])


@query()
def op6_near_duplicates(spark, sf_dir):
    """Near-duplicate class of every document, named by its smallest doc_id."""
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("place") == F.col("class_place")).alias("kept"))


def _crc_sql(number: str) -> str:
    """Unsigned CRC-32 of a number's decimal digits, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast({number} as varchar), ''),
 lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end))"""


def _planted(text: Column, doc_id: Column) -> Column:
    """The text in which, for one id in ten, the words from a place on repeat the first few of them.

    Without lambdas, since Spark does not hand a Python function an input that holds one.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    inner = F.btrim(text, F.lit("\t\n\x0b\x0c\r "))
    words = F.split(inner, r"[\x20\x09-\x0D]+")
    n = F.size(words).cast("bigint")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n.cast("int"))
    return F.when((h % 10 == 0) & (inner != ""), F.array_join(repeated, " ")).otherwise(text)


@query(rf"""with d as (select row_number() over () as rid, doc_id, {_crc_sql("doc_id")} as h,
 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
q as (select rid, doc_id, w, len(w) as n, h, (h // 10) % greatest(len(w), 1) as a, h // 10 as g from d),
t as (select rid, doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i < a then i else
 a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from q),
e as (select rid, unnest(w) as word, unnest(range(len(w))) as i from t),
pair as (select a.rid, a.i, b.i - a.i as p from e a join e b on a.rid = b.rid and a.word = b.word and a.i < b.i),
island as (select rid, p, i - row_number() over (partition by rid, p order by i) as o, i from pair),
stretch as (select rid, p, min(i) as s, count(*) + p as l from island group by rid, p, o),
run as (select rid, s, l, min(p) as p from stretch where l >= greatest(12, 2 * p) group by rid, s, l),
best as (select *, row_number() over (partition by rid order by l desc, s, p) as place from run),
gone as (select distinct rid, unnest(range(s + p, s + l)) as i from run),
kept as (select rid, string_agg(word, ' ' order by i) as words from e anti join gone using (rid, i) group by rid),
told as (select rid, count(*) as n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' order by s, p) as runs from run group by rid)
select doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(s as bigint) as start, cast(l as bigint) as length, cast(p as bigint) as period,
cast(1000 * l // p as bigint) as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from t left join told using (rid) left join kept using (rid) left join (from best where place = 1) using (rid)""")
def op11_runs(spark, sf_dir):
    """Periodic runs of words in every document, and the document without what they repeat."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", periodic_runs(_planted(F.col("text"), F.col("doc_id"))).alias("found"))
    lines = F.transform("found.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = docs.select("doc_id", F.size("found.runs").cast("bigint").alias("n_runs"), longest_run(F.col("found.runs")).alias("best"),
                        F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise("")).alias("lines"),
                        F.col("found.collapsed").alias("collapsed"))
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query()
def op12_bpe(spark, sf_dir):
    """Tokens of every document, and the text decoded from them."""
    tokenizer = Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = tokenizer.encode(table(spark, sf_dir, "documents"), ["doc_id"], decoded=True)
    return found.select("row.doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first turns taken from the first one of its hundred: (turns, all conversations).

    ``turns`` is (conv, pos, mark, size). At most five turns are taken, so a head is a short array.
    """
    h = (F.crc32(F.col("conv").cast("string")) % 6).cast("int")
    convs = turns.select("conv").distinct().withColumn("base", F.col("conv") - F.col("conv") % 100)
    heads = turns.filter("conv % 100 = 0 and pos < 5").groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("pos", "mark", "size"))).alias("head")).withColumnRenamed("conv", "base")
    convs = stage(lookup_join(convs, heads, ["base"]).withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), h)), "heads")
    own = lookup_join(turns.filter(F.col("pos") >= h), convs.select("conv", (F.size("head") - h).alias("move")), ["conv"], "inner")
    taken = convs.select("conv", F.explode("head").alias("t")).select("conv", "t.*")
    return stage(own.withColumn("pos", F.col("pos") + F.col("move")).drop("move").unionByName(taken), "rebuilt"), convs


@query(f"""with own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 as pos,
 coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, {_crc_sql("conv_id")} % 6 as h, count(*) as n from own group by conv_id),
r as (select c.conv_id, pos, role, text from c join own on own.conv_id = c.base and pos < h
 union all select c.conv_id, pos - c.h + least(c.h, coalesce(b.n, 0)), role, text from c join own using (conv_id) left join c b on b.conv_id = c.base
 where pos >= c.h),
p as (select conv_id, pos + 1 as depth, length(text) as size, string_agg(length(role) || ':' || role || sha256(text), '') over (partition by conv_id order by pos) as k from r
 union all select conv_id, 0, 0, '' from c),
m as (select *, lag(k) over w as up, lead(k) over w is null as is_last from p window w as (partition by conv_id order by depth)),
n as (select depth, k, min(conv_id) as conv_id, count(*) as n_convs, min(up) as up, any_value(size) as size,
 string_agg(case when is_last then cast(conv_id as varchar) end, ',' order by conv_id) as ids from m group by depth, k),
kids as (select up as k, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by 1, 2),
f as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (depth, k)),
below as (select a.depth, a.k, sum(case when v.n_children = 0 then 1 else 0 end) as n_leaves, sum((v.n_convs - 1) * v.size) as saved
 from f v join p on p.conv_id = v.conv_id and p.depth <= v.depth join f a on a.depth = p.depth and a.k = p.k group by 1, 2)
select f.conv_id, cast(f.depth as bigint) as depth, u.conv_id as parent_conv_id, cast(f.n_convs as bigint) as n_convs, cast(f.n_children as bigint) as n_children,
cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(f.ids, '')) as ends_sha256
from f join below using (depth, k) left join f u on u.depth = f.depth - 1 and u.k = f.up""")
def op13_trie(spark, sf_dir):
    """Prefix trie of the rebuilt conversations."""
    turns = stage(trie.placed(trie.marked(table(spark, sf_dir, "conversations"))), "placed")
    return trie.prefix_trie(*_rebuilt(turns))
