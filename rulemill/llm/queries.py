"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from .common import table


def op1_ngram_join(spark, sf_dir):
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_language_id(spark, sf_dir):
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op4_personal_data(spark, sf_dir):
    from .pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    from .substring import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans", "factors")


def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_quality_rules(spark, sf_dir):
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("broken")


def op8_exact_dedup(spark, sf_dir):
    from .exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_importance_resampling(spark, sf_dir):
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark, sf_dir):
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark, sf_dir):
    from .codebooks import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def queries():
    found = [v for k, v in globals().items() if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def _quality_sql():
    from .quality import RULES, STOP_WORDS

    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    bounds = [f"{r.metric} >= {r.low}" for r in RULES if r.low is not None] + [f"{r.metric} <= {r.high}" for r in RULES if r.high is not None]
    return rf"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as w,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\x0b\f\r]')) as l from d),
        u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
        g as (select doc_id, i, x || ' ' || lead(x) over p || ' ' || lead(x, 2) over p as g from u window p as (partition by doc_id order by i)),
        c as (select doc_id, i, count(*) over (partition by doc_id, g) as n from g where g is not null),
        r as (select doc_id, count(distinct k) as n from (select doc_id, unnest([i, i + 1, i + 2]) as k from c where n > 1) group by 1),
        m as (select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
            coalesce(r.n, 0)::bigint as n_repeat_words,
            len(list_filter(w, lambda x: lower(regexp_replace(x, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')) in ({stops}))) / greatest(len(w), 1)::double as stop_word_share,
            len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / greatest(len(w), 1)::double as alpha_word_share,
            len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\n\f\r]*$'))) / greatest(len(l), 1)::double as ellipsis_line_share,
            len(list_filter(l, lambda x: regexp_matches(x, '^[ \t\n\f\r]*[-•*][ \t\n\f\r]'))) / greatest(len(l), 1)::double as bullet_line_share,
            greatest(len(l), 1) as l1 from w left join r using (doc_id)),
        k as (select *, word_chars / greatest(n_words, 1)::double as mean_word_chars, n_symbols / greatest(n_words, 1)::double as symbols_per_word, n_dup_lines / l1::double as dup_line_share,
            n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(bounds)} as kept from k"""


def _importance_sql():
    """CRC-32 by its table, over distinct words."""
    from .importance import BUCKETS, LEAST_WORDS, PERCENT, SEED, WORD

    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    return rf"""
        with recursive steps(i, k, v) as (
            select i, 0, i from range(256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from steps where k < 8),
        tab as (select list(v order by i) as c from steps where k = 8),
        d as (select row_number() over () as r, doc_id, {words} as w from documents),
        u as (select r, unnest(w) as x from d),
        v as (select unnest({words}) as x from benchmark),
        x as (select x, hex(encode(x)) as h from (select x from u union select x from v)),
        b as (select x, list_reduce([4294967295] || list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p::int, 2))::bigint),
            lambda a, y: xor(c[(xor(a, y) & 255) + 1], a >> 8)) as crc from x, tab),
        k as (select x, (xor(crc, 4294967295) % {BUCKETS}) as b from b),
        s as (select b, count(*) as n from u join k using (x) group by b),
        t as (select b, count(*) as n from v join k using (x) group by b),
        g as (select r.b, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((select coalesce(sum(n), 0) from s) + {BUCKETS})::double
            / ((coalesce(s.n, 0) + 1) * ((select coalesce(sum(n), 0) from t) + {BUCKETS})::double))) as g
            from range({BUCKETS}) r(b) left join s on s.b = r.b left join t on t.b = r.b),
        w as (select r, floor(sum(g) / count(*))::bigint as w from u join k using (x) join g using (b) group by r),
        f as (select doc_id, len(d.w)::bigint as n_features, coalesce(w.w, 0) as weight,
            ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint as h from d left join w using (r)),
        e as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score, n_features >= {LEAST_WORDS} as long from f),
        o as (select *, row_number() over (partition by long order by score desc, doc_id) as n, {PERCENT} * count(*) over (partition by long) // 100 as keep from e)
        select doc_id, n_features, weight, score, case when long and n <= keep then n end as rank from o"""


def _codes_sql():
    """Every round of the integer k-means as a common table expression."""
    from .codebooks import ENTRIES, PARTS, ROUNDS, SCALE

    def nearest(i):
        return f"""
        m{i} as materialized (select r, p, min(struct_pack(d := d, e := e)) as m from (
            select x.r, x.p, c.e, sum((x.x - c.c) * (x.x - c.c))::bigint as d from x join c{i} c on c.p = x.p and c.i = x.i group by x.r, x.p, c.e) group by r, p)"""

    rounds = "".join(
        f"""{nearest(i)},
        c{i + 1} as materialized (select c.p, c.e, c.i, coalesce(n.c, c.c) as c from c{i} c left join (
            select x.p, m.m.e as e, x.i, floor(sum(x.x) / count(*))::bigint as c from x join m{i} m on m.r = x.r and m.p = x.p group by 1, 2, 3) n
            on n.p = c.p and n.e = c.e and n.i = c.i),"""
        for i in range(ROUNDS)
    )
    return f"""
        with k as materialized (select row_number() over (order by vec_id) - 1 as r, vec_id, label, embedding from embeddings
            where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
        w as (select max(len(embedding)) // {PARTS} as w from k),
        x as materialized (select r, (j // w) as p, (j % w) as i, floor({SCALE} * embedding[j + 1]::double)::bigint as x
            from (select r, embedding, unnest(range(len(embedding))) as j from k), w),
        c0 as materialized (select p, r as e, i, x as c from x where r < {ENTRIES}),{rounds}{nearest(ROUNDS)},
        o as (select r, string_agg(printf('%02x', m.e), '' order by p) as code, sum(m.d)::bigint as error from m{ROUNDS} group by r)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
            (select sha256(string_agg(c::varchar, ',' order by p, e, i)) from c{ROUNDS}) as codebooks_sha256
        from o join k using (r)"""


SQL = {
    "op8_exact_dedup": """
        with d as (
            select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
            from documents)
        select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
            count(*) over (partition by text_sha256) as group_size,
            doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
        from d""",
}


def oracle_sql():
    return SQL | {"op7_quality_rules": _quality_sql(), "op11_importance_resampling": _importance_sql(), "op13_vector_codes": _codes_sql()}
