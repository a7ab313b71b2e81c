"""The queries opN_<name> with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitcodes, codebooks, kdtree, langid, license, merkle, mixing, pii, prefixtrie, simhash, spm, tokenfile, urlfilter

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), 5)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.summary(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(_table(spark, sf_dir, "documents"), PIECES, "doc_id").select("doc_id", "n_ids", "ids_crc32", "exact")


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitcodes.nearest(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), 10)


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(_table(spark, sf_dir, "embeddings"))


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.build(_table(spark, sf_dir, "conversations"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: the base spans of each kind."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: sizes, and each source's target."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def urlfilter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: hosts, paths and rules."""
    return op8_urlfilter(spark, sf_dir).select("page_id", "host", "path", "rule")


def merkle_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: lengths and the edited texts."""
    return op9_merkle(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_pii, op2_simhash, op3_topk, op4_tokens, op5_langid, op6_mixing, op7_license, op8_urlfilter, op9_merkle, op10_sentencepiece, op11_ann, op12_codebooks, op13_prefixtrie, pii_counts, mixing_targets, urlfilter_rules, merkle_edits]
    return {f.__name__: f for f in ops}


def _targets_sql(rounds: int = 8) -> str:
    """Shares by weight; a round fixes the sources above three times their size there and shares what is left among the others."""
    steps = []
    for i in range(rounds):
        steps.append(f"""t{i + 1} as (select source, size, weight, fixed or target > 3.0 * size as fixed, case when fixed or target > 3.0 * size then 3.0 * size end as held from s{i}),
            s{i + 1} as (select source, size, weight, fixed, case when fixed then held else ((select sum(size) from t{i + 1}) - coalesce((select sum(held) from t{i + 1}), 0)) * weight / (select sum(weight) from t{i + 1} where not fixed) end as target from t{i + 1})""")
    return rf"""
            with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
            g as (select source, cast(sum(size) as double) as size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by source),
            s0 as (select source, size, weight, false as fixed, (select sum(size) from g) * weight / (select sum(weight) from g) as target from g),
            {", ".join(steps)}
            select doc_id, d.size, cast(s.size as bigint) as source_size, round(s.target, 6) as target from d join s{rounds} s on s.source is not distinct from d.source"""


def _codebooks_sql(parts: int = codebooks.PARTS, entries: int = codebooks.ENTRIES, rounds: int = codebooks.ROUNDS) -> str:
    """One pair of steps a round: assignment of every part, then floored means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (
              select rid, part, entry, d from (
                select rid, part, entry, d, row_number() over (partition by rid, part order by d, entry) as r
                from (select x.rid, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c)) as d from x join b{i} b on b.part = x.part and b.pos = x.pos group by x.rid, x.part, b.entry)
              ) where r = 1)""")
        if i < rounds:
            steps.append(f"""b{i + 1} as materialized (
              select b.part, b.entry, b.pos, coalesce(s.c, b.c) as c from b{i} b left join (
                select x.part, a.entry, x.pos, cast(floor(sum(x.c) / cast(count(*) as double)) as bigint) as c
                from x join a{i} a on a.rid = x.rid and a.part = x.part group by x.part, a.entry, x.pos
              ) s on s.part = b.part and s.entry = b.entry and s.pos = b.pos)""")
    return f"""
            with v as materialized (
              select row_number() over (order by vec_id nulls last) as rid, vec_id, label, list_transform(embedding, lambda x: cast(floor({codebooks.SCALE} * cast(x as double)) as bigint)) as v
              from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
            ), w as (select cast(ceil(max(len(v)) / {parts}.0) as bigint) as w from v),
            x as materialized (
              select rid, cast(floor(i / w) as bigint) as part, i % w as pos, coalesce(v[i + 1], 0) as c from (select rid, v, w, unnest(generate_series(0, w * {parts} - 1)) as i from v, w)
            ), b0 as materialized (select part, rid - 1 as entry, pos, c from x where rid <= {entries}),
            {", ".join(steps)},
            books as (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) as sha from b{rounds}),
            coded as (select rid, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a{rounds} group by rid)
            select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, sha as codebooks_sha256 from coded join v using (rid), books"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk": """
            with v as (
              select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
              where vec_id is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
            ), s as (
              select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
            ), r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
            select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
        "pii_counts": r"""
            with t as (select doc_id, coalesce(text, '') as text from documents),
            m as (
              select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as n_email, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as ips,
                list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as cards,
                list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as phones from t
            )
            select doc_id, n_email, len(list_filter(ips, lambda x: len(list_filter(split(x, '.'), lambda p: not regexp_full_match(p, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])'))) = 0)) as n_ip,
              len(list_filter(cards, lambda x: len(x) between 16 and 19 and list_sum(list_transform(generate_series(1, len(x)), lambda i:
                case when (len(x) - i) % 2 = 0 then cast(x[i] as integer) when cast(x[i] as integer) > 4 then cast(x[i] as integer) * 2 - 9 else cast(x[i] as integer) * 2 end)) % 10 = 0)) as n_card,
              len(list_filter(phones, lambda x: len(x) between 8 and 15)) as n_phone from m""",
        "mixing_targets": _targets_sql(),
        "urlfilter_rules": r"""
            with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
            s as (select page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw, coalesce(regexp_replace(regexp_extract(rest, '^[^?#]*'), '^[^/?#]*', ''), '') as path from u),
            p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from s),
            r as (select * from (values ('org', '/'), ('example.org', '/es/'), ('example.org', '/en/1'), ('com', '/fr/'), ('com', '/de/')) as x(rule_host, rule_path)),
            f as (select page_id, rule_host || rule_path as rule, row_number() over (partition by page_id order by len(rule_host || rule_path) desc) as n from p join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
            select p.page_id, host, path, rule from p left join f on f.page_id = p.page_id and n = 1""",
        "merkle_edits": """
            with t as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc) as r, count(*) over () as n from documents),
            p as (select a.doc_id, a.text, length(a.text) as size, b.text as next from t a join t b on b.r = a.r % a.n + 1)
            select doc_id, size as n_chars, sha256(left(text, size - size // 2) || left(next, size // 2)) as edited_sha256 from p""",
        # the exact search; the codes' error bounds left out none of its rows in any test
        "op11_ann": """
            with v as (
              select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
              where vec_id is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), s as (
              select q.vec_id as query_id, c.vec_id as vec_id,
                sqrt(list_reduce(list_prepend(cast(0 as double), list_transform(generate_series(1, len(q.v)), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i]))), lambda a, b: a + b)) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
            ), r as (select query_id, row_number() over (partition by query_id order by score, vec_id) as rank, vec_id, score from s)
            select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
        "op12_codebooks": _codebooks_sql(),
        "op13_prefixtrie": """
            with t as (
              select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
              from conversations where conv_id is not null
            ), n as (select c, count(*) as n, c - c % 5 as base, list_transform(split(cast(c as varchar), ''), lambda x: ascii(x)) as b from t group by c),
            bits as (select c, n, base, flatten(list_transform(b, lambda x: [x, 0, 0, 0, 0, 0, 0, 0])) as e from n),
            h as (
              select c, n, base, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(e, lambda x: cast(x as bigint))),
                lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), cast(4294967295 as bigint)) % 9 as h from bits
            ), k as (select h.c, h.base, h.h, least(h.h, coalesce(b.n, 0)) as m from h left join h b on b.c = h.base),
            rebuilt as (
              select k.c, t.pos as d, t.role, t.text from k join t on t.c = k.base and t.pos <= k.h
              union all select k.c, t.pos - k.h + k.m, t.role, t.text from k join t on t.c = k.c and t.pos > k.h
            ), path as (
              select c, d, octet_length(encode(text)) as bytes, list({'role': role, 'text': text}) over (partition by c order by d rows between unbounded preceding and current row) as seq from rebuilt
              union all select c, 0, 0, [] from k
            ), last as (select c, max(d) as d from path group by c),
            node as (select seq, d, min(c) as c, count(*) as convs, any_value(bytes) as bytes from path group by seq, d),
            spot as (select p.c, p.d, n.c as owner from path p join node n on n.seq = p.seq),
            kids as (select a.owner, a.d, count(*) as n from node x join spot a on a.c = x.c and a.d = x.d - 1 where x.d > 0 group by a.owner, a.d),
            own as (select x.c, x.d, x.convs, x.bytes, coalesce(y.n, 0) as n_children from node x left join kids y on y.owner = x.c and y.d = x.d),
            sums as (
              select a.owner, a.d, sum(cast(o.n_children = 0 as bigint)) as leaves, sum((o.convs - 1) * o.bytes) as saved
              from own o join spot a on a.c = o.c and a.d <= o.d group by a.owner, a.d
            ), ends as (select a.owner, a.d, sha256(string_agg(cast(l.c as varchar), ',' order by l.c)) as sha from last l join spot a on a.c = l.c and a.d = l.d group by a.owner, a.d)
            select o.c as conv_id, o.d as depth, p.owner as parent_conv_id, o.convs as n_convs, o.n_children, cast(s.leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens,
              coalesce(e.sha, sha256('')) as ends_sha256
            from own o join sums s on s.owner = o.c and s.d = o.d left join spot p on p.c = o.c and p.d = o.d - 1 left join ends e on e.owner = o.c and e.d = o.d""",
    }
