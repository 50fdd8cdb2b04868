"""Queries of the training-data operators: name to (spark, sf_dir) -> DataFrame, and SQL where SQL can say the same."""

from __future__ import annotations

from tallyloom.llm.common import documents
from tallyloom.llm.decontamination import op9_decontamination
from tallyloom.llm.hmm import op6_hmm
from tallyloom.llm.interactions import op12_interactions
from tallyloom.llm.jaccard import op2_jaccard_join
from tallyloom.llm.licenses import TEMPLATES, op8_licenses
from tallyloom.llm.media import op3_media
from tallyloom.llm.packing import op1_packing
from tallyloom.llm.pii import op10_pii
from tallyloom.llm.resampling import op11_resampling
from tallyloom.llm.simhash import op13_simhash
from tallyloom.llm.token_counts import op4_token_counts
from tallyloom.llm.toxicity import op5_toxicity
from tallyloom.llm.warc import op7_warc

QUERIES = {
    "op1_packing": lambda spark, d: op1_packing(documents(spark, d)),
    "op2_jaccard_join": op2_jaccard_join,
    "op3_media": lambda spark, d: op3_media(documents(spark, d)),
    "op4_token_counts": lambda spark, d: op4_token_counts(documents(spark, d)),
    "op5_toxicity": op5_toxicity,
    "op6_hmm": lambda spark, d: op6_hmm(documents(spark, d)),
    "op7_warc": op7_warc,
    "op8_licenses": lambda spark, d: op8_licenses(documents(spark, d)),
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
    "op11_resampling": op11_resampling,
    "op12_interactions": op12_interactions,
    "op13_simhash": op13_simhash,
}

#: Word of documents and benchmark texts: what stands between other ASCII characters.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())


def _bigrams(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words})), lambda j: {words}[j] || ' ' || {words}[j + 1]))"


ORACLE_SQL: dict[str, str] = {
    "op8_licenses": f"""
        with t as (select name, {_bigrams('ws')} as g from (select name, {_WORDS} as ws from (values {_TEMPLATE_ROWS}) as v(name, text))),
        l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
        w as (select doc_id, i, {_WORDS} as ws from l),
        b as (select *, sum(case when len(ws) = 0 then 1 else 0 end) over (partition by doc_id order by i) as block from w),
        k as (select doc_id, block, flatten(list(ws order by i)) as ws, count(*) as n, min(i) as i from b where len(ws) > 0 group by 1, 2),
        d as (select doc_id, flatten(list(ws order by i)) as ws, count(*) as n from k group by 1),
        u as (select doc_id, 1000000000 + i as unit, ws from w where len(ws) > 0 union all select doc_id, i, ws from k where n > 1 union all select doc_id, 0, ws from d where n > 1),
        g as (select doc_id, unit, {_bigrams('ws')} as g from u),
        m as (select doc_id, unit, name, 2.0::double * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) as dice from g join t on len(t.g) > 0 and 2 * least(len(g.g), len(t.g)) >= 0.8 * (len(g.g) + len(t.g))),
        best as (select * from m where dice >= 0.8 qualify row_number() over (partition by doc_id, unit order by dice desc, name) = 1),
        s as (select doc_id, count(*) as n_matches, string_agg(distinct name, ',' order by name) as licenses, first(name order by dice desc, name) as best_license, round(max(dice), 6) as best_dice from best group by 1)
        select doc_id, coalesce(n_matches, 0) as n_matches, coalesce(licenses, '') as licenses, best_license, best_dice from documents left join s using (doc_id)""",
    "op7_warc": """
        with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n from pages), k as (select h, max(page_id) as keeper from p where n >= 1000 group by 1)
        select page_id, n as payload_bytes, sha1(h) as payload_digest, case when keeper is null or keeper = page_id then 'response' else 'revisit' end as record_type, case when keeper <> page_id then keeper end as refers_to from p left join k using (h)""",
    "op2_jaccard_join": f"""
        with recursive w as (select doc_id, {_WORDS} as ws from documents),
        g as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
            else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as s from w),
        n as (select doc_id, count(*) as n from g group by 1),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c) - 1e-6),
        r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on l.a = r.b)
        select d.doc_id, min(r.b) as class_id, (select count(*) from l where l.a = d.doc_id) as n_links from documents d join r on r.a = d.doc_id group by d.doc_id""",
    "op9_decontamination": f"""
        with i as (select cast(item_id as varchar) as item, {_WORDS} as ws from benchmark),
        k as (select item, unnest(case when len(ws) = 0 then [] when len(ws) < 13 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 11), lambda j: array_to_string(ws[j:j + 12], ' ')) end) as win, least(len(ws), 13) as n from i),
        w as (select doc_id, {_WORDS} as ws from documents),
        lens as (select distinct n from k),
        o as (select doc_id, n, list_transform(range(1, len(ws) - n + 2), lambda j: array_to_string(ws[j:j + n - 1], ' ')) as wins from w, lens where len(ws) >= n),
        e as (select doc_id, n, unnest(wins) as win, generate_subscripts(wins, 1) as pos from o),
        h as (select e.doc_id, e.pos, e.n, k.item from e join k on k.n = e.n and k.win = e.win),
        hits as (select distinct doc_id, unnest(range(pos, pos + n)) as p from h),
        c as (select doc_id, count(*) as n_hit from hits group by 1),
        t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by 1)
        select w.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from w left join c using (doc_id) left join t using (doc_id)""",
    "op11_resampling": f"""
        with steps as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
        w as (select doc_id, {_WORDS} as ws, row_number() over () as row from documents),
        b as (select {_WORDS} as ws from benchmark),
        dw as (select row, unnest(ws) as word from w), bw as (select unnest(ws) as word from b),
        v as (select distinct word from (select word from dw union all select word from bw)),
        x as (select word, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::bigint) as bytes from v),
        h as (select word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % 10000 as bucket from x, steps),
        s as (select bucket, count(*) as n from dw join h using (word) group by 1), t as (select bucket, count(*) as n from bw join h using (word) group by 1),
        total as (select (select count(*) from dw) as s, (select count(*) from bw) as t),
        g as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (total.s + 10000)::double / ((coalesce(s.n, 0) + 1) * (total.t + 10000)::double)))::bigint as gain from s full join t using (bucket), total),
        f as (select row, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from dw join h using (word) join g using (bucket) group by 1),
        u as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from w left join f using (row)),
        c as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from u),
        r as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as place, count(*) filter (n_features >= 20) over () as n from c)
        select doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from r""",
    "op12_interactions": r"""
        with recursive d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
        w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as first_id from d),
        m as (select doc_id, part, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
            + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first_id, false)::int as mask from w),
        l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
        c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l using (doc_id) group by 1, 2),
        o as (select '' as o union all select o || f from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) where not contains(o, f)),
        s as (select o, step, 1 << (ascii(o[step]) - 65) as bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))), 0)::int as gone from o, range(1, 6) as r(step) where length(o) = 5),
        e as (select part, o as filter_order, step::int as step, bit, sum(case when mask & (gone | bit) = 0 then n else 0 end) as kept, sum(case when mask & bit > 0 and mask & gone = 0 then n else 0 end) as removed,
            sum(case when mask & bit > 0 and mask & gone > 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
            sum(case when mask & bit > 0 and mask & gone = 0 then good else 0 end) as good_lost, sum(case when mask & bit > 0 and mask & gone = 0 then toxic else 0 end) as toxic_lost from c, s group by 1, 2, 3, 4)
        select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
            (sum(removed) over (partition by part, bit))::bigint as shapley from e""",
}
