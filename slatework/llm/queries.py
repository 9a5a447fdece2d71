"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .anisotropic import op8_anisotropic
from .divergence import op13_source_divergence
from .fillmiddle import op11_fill_middle
from .huffman import op5_huffman
from .normbuckets import op9_norm_buckets
from .ordermin import op12_order_minhash
from .packing import op6_packing
from .quality import op1_quality
from .sharding import op4_sharding
from .simhash import op10_simhash
from .substrings import op7_substrings
from .tokencount import op2_token_counts
from .wordbpe import op3_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_sharding": op4_sharding,
    "op5_huffman": op5_huffman,
    "op6_packing": op6_packing,
    "op7_substrings": op7_substrings,
    "op8_anisotropic": op8_anisotropic,
    "op9_norm_buckets": op9_norm_buckets,
    "op10_simhash": op10_simhash,
    "op11_fill_middle": op11_fill_middle,
    "op12_order_minhash": op12_order_minhash,
    "op13_source_divergence": op13_source_divergence,
}

#: The others are no SQL: libraries' tokenizers, a file format, draws at random, approximate search, a hash that SQL lacks.
ORACLE_SQL: dict[str, str] = {
    "op7_substrings": r"""with d as (select rowid_ as rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from (select *, row_number() over () rowid_ from documents)),
 win as (select rid, i, array_to_string(ws[i:i + 34], ' ') k from (select rid, ws, unnest(range(1, len(ws) - 33)) i from d)),
 dup as (select k from win group by k having count(*) > 1), gone as (select distinct rid, unnest(range(i, i + 35)) p from win semi join dup using (k)),
 word as (select rid, unnest(ws) w, generate_subscripts(ws, 1) p from d), kept as (select rid, string_agg(w, ' ' order by p) t from word anti join gone using (rid, p) group by rid), n as (select rid, count(*) removed from gone group by rid)
 select doc_id, cast(len(ws) as bigint) n_words, coalesce(removed, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (rid) left join n using (rid)""",
    "op9_norm_buckets": """with v as (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.rid, q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score from v q join v c on q.rid <> c.rid where q.vec_id % 50 = 0),
 r as (select *, row_number() over (partition by rid order by score desc, vec_id) rank from s) select query_id, cast(rank as int) rank, vec_id, score from r where rank <= 5""",
    "op11_fill_middle": r"""with h as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) s from documents),
 r as (select *, cast('0x' || s[1:8] as bigint) h1, cast('0x' || s[9:16] as bigint) h2, cast('0x' || s[17:24] as bigint) h3, cast('0x' || s[25:32] as bigint) h4 from h),
 c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from r),
 p as (select *, substr(t, 1, a) pre, substr(t, a + 1, b - a) mid, substr(t, b + 1) suf from c)
 select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(a as bigint) end prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(case form when 'plain' then t else pre || mid || suf end) restored_sha256 from p""",
    "op13_source_divergence": r"""with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
 g as (select distinct lang, source from d), w as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
 k as (select lang, term, count(*) total from w group by all having count(distinct rid) >= 10), c as (select lang, source, term, count(*) n from w semi join k using (lang, term) group by all),
 vl as (select lang, count(*) v, sum(total) nl from k group by lang), ng as (select lang, source, sum(n) ng from c group by all),
 x as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 2) // (coalesce(ng, 0) + 2 * v) p, 1 + cast(1000000000 as hugeint) * (total + 2) // (nl + 2 * v) q
  from g join k using (lang) join vl using (lang) left join ng using (lang, source) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
 f as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) s from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
 r as (select a.lang, a.source, 'pair' part, b.source item, coalesce(s, 0) s from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from x where n > 0 and p > q),
 o as (select *, row_number() over (partition by lang, source, part order by s desc, item) rank from r)
 select lang, source, part, item, cast(s as bigint) as value, cast(rank as int) rank from o where part = 'pair' or rank <= 10""",
}
