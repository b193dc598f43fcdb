"""SQL counterparts of text operators that take more than a few lines."""

from __future__ import annotations

from collections.abc import Sequence

from barscreen.llm import urls

HARD_NEGATIVES = """
    with whole as (
        select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
               list_transform(embedding, lambda x: floor(256 * x::double)) as vec
        from embeddings
        where vec_id is not null and label is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pairs as materialized (
        select a.vec_id as anchor_id, x.vec_id, x.label = a.label as same,
               list_inner_product(a.vec, x.vec)::bigint as score
        from whole a join whole x on a.vec_id % 100 = 0 and x.vec_id <> a.vec_id),
    positives as (
        select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
        qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select anchor_id, positive_id,
           (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
           vec_id as negative_id, positive_score, score as negative_score
    from positives join pairs using (anchor_id)
    where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
    qualify rank <= 10"""


def crc32_table() -> list[int]:
    """What CRC-32 adds for each byte: eight steps of the reflected polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def spelling_variants() -> str:
    """CRC-32 byte by byte; near words by equal words with one letter masked or left out."""
    return rf"""
        with recursive runs as (
            select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{urls.UPPER}', '{urls.LOWER}') as run
            from documents),
        places as (
            select run, count(*) as c, hex(coalesce(doc_id::varchar, '') || ':' || run) as hexed
            from runs group by doc_id, run),
        hashed as (
            select run, c, xor(4294967295::bigint, list_reduce(
                list_prepend(4294967295::bigint, list_transform(range(1, length(hexed), 2), lambda i: ('0x' || substr(hexed, i, 2))::bigint)),
                lambda h, b: xor(h >> 8, ({crc32_table()}::bigint[])[(xor(h, b) & 255) + 1]))) as h
            from places),
        typed as (
            select c, case when h % 31 = 0
                then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word
            from hashed),
        words as materialized (
            select word, sum(c)::bigint as n from typed where length(word) >= 7 group by word having sum(c) >= 2),
        spots as materialized (
            select word, n, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail, i
            from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
        pairs as (
            select a.word, a.n, b.word as near, b.n as near_n
            from spots a join spots b on a.head = b.head and a.tail = b.tail and a.i = b.i and a.word <> b.word),
        shorter as (
            select distinct a.word, a.n, b.word as near, b.n as near_n
            from spots a join words b on a.head || a.tail = b.word),
        near as (
            select * from pairs union all select * from shorter union all select near, near_n, word, n from shorter),
        best as (
            select word, count(*) as n_near,
                   arg_min(struct_pack(form := near, form_n := near_n), struct_pack(x := -near_n, y := near)) as b
            from near group by word),
        forms as materialized (
            select word, n, coalesce(n_near, 0) as n_near,
                   case when b.form_n >= 10 * n then b.form end as form,
                   case when b.form_n >= 10 * n then b.form_n end as form_n
            from words left join best using (word)),
        walk as (
            select word, word as place, 0 as step from forms
            union all
            select w.word, f.form, step + 1 from walk w join forms f on w.place = f.word where f.form is not null),
        roots as (select word, arg_max(place, step) as root from walk group by word)
        select word, form, root, n, n_near, form_n from forms join roots using (word)"""


def url_filters(rules: Sequence[urls.Rule], damping: float = 0.85, rounds: int = 20, least: float = 0.01) -> str:
    """The rules as conditions, and the terms of the PageRank series one after another."""
    listed = ", ".join(f"('{r.host}', '{r.path}', '{r.host}{r.path}', '{r.verdict}')" for r in rules)
    link = urls.LINK.replace("'", "''")
    lower = f"'{urls.UPPER}', '{urls.LOWER}'"
    terms = "".join(
        f"""
        term{k + 1} as materialized (
            select kind, way_end as host, sum(cast(floor(cast(mass as double) * {damping} * share) as bigint))::bigint as mass
            from flows join term{k} on kind = of_kind and way_start = host
            group by all having sum(cast(floor(cast(mass as double) * {damping} * share) as bigint)) > 0),"""
        for k in range(rounds)
    )
    every = " union all ".join(f"select * from term{k}" for k in range(rounds + 1))
    return rf"""
        with rules(rule_host, rule_path, rule, rule_verdict) as (values {listed}),
        cut as (
            select page_id, html,
                   case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
            from pages),
        parts as (
            select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) as host,
                   regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') as path
            from cut),
        judged as (
            select page_id, host, path, b.rule, b.rule_verdict
            from parts left join lateral (
                select rule, rule_verdict from rules
                where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
                order by length(rule) desc, length(rule_host) desc, rule limit 1) b on true),
        links as (
            select src, dst, count(*) as n from (
                select host as src, unnest(list_distinct(
                    list_transform(regexp_extract_all(html, '{link}', 1), lambda x: translate(x, {lower})))) as dst
                from parts where host <> '') where src <> dst group by all),
        ways as (
            select 'trust' as of_kind, src as way_start, dst as way_end, n from links
            union all select 'distrust', dst, src, n from links),
        flows as materialized (
            select of_kind, way_start, way_end, cast(n as double) / cast(sum(n) over (partition by of_kind, way_start) as double) as share
            from ways),
        counts as (
            select host, count(*) as n, count(*) filter (rule_verdict = 'allow') as allowed,
                   count(*) filter (rule_verdict = 'block') as blocked
            from judged where host <> '' group by host),
        term0 as materialized (
            select case when 2 * allowed > n then 'trust' else 'distrust' end as kind, host, {urls.SEED}::bigint as mass
            from counts where 2 * allowed > n or 2 * blocked > n),{terms}
        masses as (
            select host, coalesce(sum(mass) filter (kind = 'trust'), 0)::bigint as trust,
                   coalesce(sum(mass) filter (kind = 'distrust'), 0)::bigint as distrust
            from ({every}) group by host)
        select page_id, host, path, rule,
               coalesce(rule_verdict, case when distrust >= {int(least * urls.SEED)} and distrust > trust then 'block' end, 'allow') as verdict,
               coalesce(trust, 0) as trust, coalesce(distrust, 0) as distrust
        from judged left join masses using (host)"""
