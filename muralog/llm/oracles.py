"""The same results in SQL, for the operators that SQL can express."""

from __future__ import annotations

from muralog.llm import url_trust


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_sql() -> str:
    """Base statistics by unnesting, then the minimum covariance determinant written out, from the definition.

    Chi-square quantiles for 1 to 4 degrees: the median, 97.5 %, and what is exceeded with a chance of 10^-12.
    """
    index, pairs = range(4), [(i, j) for i in range(4) for j in range(i, 4)]
    median_of, most_of, cutoff_of = (
        "[0.45493642311957283, 1.3862943611198906, 2.3659738843753377, 3.3566939800333224]",
        "[5.023886187314888, 7.377758908227871, 9.348403604496148, 11.143286781877796]",
        "[50.84389, 55.26204, 58.9203, 62.2003]")
    cell = lambda a, i, j: f"{a}{min(i, j)}{max(i, j)}"
    many = lambda text, over: ", ".join(text(*k) if isinstance(k, tuple) else text(k) for k in over)
    distance = "greatest(" + " + ".join(f"p{i}{j} * (t{i} - m{i}) * (t{j} - m{j})" + ("" if i == j else " * 2") for i, j in pairs) + ", 0)"
    steps = [rf"""
        words AS (
            SELECT doc_id, lang, source, row, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents)),
        windows AS (
            SELECT row, i, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS three
            FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
        repeated AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, three) AS n FROM windows) WHERE n > 1),
        covered AS (SELECT row, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS t(k) GROUP BY row),
        lines AS (
            SELECT row, count(*) - count(DISTINCT line) AS n
            FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM words)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
        base AS (
            SELECT doc_id, lang, source, row, len(w) AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
                   length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS letters, len(list_distinct(w)) AS new
            FROM words LEFT JOIN lines l USING (row) LEFT JOIN covered c USING (row)),
        judged AS (SELECT *, greatest(n_words, 1)::DOUBLE AS n, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
        placed AS (
            SELECT *, ln((word_chars + 1) / n) AS z0, ln((word_chars - letters + 1)::DOUBLE / (letters + 1)) AS z1, ln((new + 1) / (n - new + 1)) AS z2, ln(n) AS z3,
                   sqrt(n / (n + 400)) AS say, coalesce('l' || lang, 'none') AS l, coalesce('l' || lang, 'none') || chr(31) || coalesce('s' || source, 'none') AS ls FROM judged),
        one AS (SELECT *, CASE WHEN count(*) FILTER (NOT base_failed) OVER (PARTITION BY ls) >= 50 THEN ls ELSE l END AS g1 FROM placed),
        grouped AS (SELECT *, CASE WHEN count(*) FILTER (NOT base_failed) OVER (PARTITION BY g1) >= 50 THEN g1 ELSE 'all' END AS grp FROM one),
        passed AS MATERIALIZED (
            SELECT * FROM grouped WHERE NOT base_failed AND grp IN (SELECT grp FROM grouped WHERE NOT base_failed GROUP BY grp HAVING count(*) >= 50)),
        medians AS (SELECT grp, {many(lambda i: f'quantile_disc(z{i}, 0.5) AS c{i}', index)} FROM passed GROUP BY grp),
        deviations AS (SELECT grp, {many(lambda i: f'quantile_disc(abs((z{i} - c{i}) * say), 0.5) AS d{i}', index)} FROM passed JOIN medians USING (grp) GROUP BY grp),
        located AS MATERIALIZED (
            SELECT g.*, {many(lambda i: f'(z{i} - c{i}) * say / CASE WHEN d{i} > 0 THEN d{i} * 1.4826 ELSE 1 END AS t{i}', index)}
            FROM grouped g LEFT JOIN medians USING (grp) LEFT JOIN deviations USING (grp)),
        members AS MATERIALIZED (SELECT grp, t0, t1, t2, t3 FROM located WHERE row IN (SELECT row FROM passed)),
        lengths AS (SELECT *, sqrt(t0 * t0 + t1 * t1 + t2 * t2 + t3 * t3) AS length FROM members),
        drawn AS (
            SELECT grp || '#1' AS key, {many(lambda i: f'tanh(t{i}) AS t{i}', index)} FROM lengths UNION ALL
            SELECT grp || '#2', {many(lambda i: f'CASE WHEN length > 0 THEN t{i} / length ELSE 0 END', index)} FROM lengths),
        tried AS MATERIALIZED (SELECT grp || '#' || k AS key, t0, t1, t2, t3 FROM members, (VALUES (0), (1), (2)) AS starts(k))"""]

    def estimate(name: str, rows: str, key: str) -> None:
        live = lambda i: f"(v{i}{i} > 1e-9)"
        steps.append(f"""
        {name}_s AS (SELECT {key}, {many(lambda i: f'avg(t{i}) AS m{i}', index)}, {many(lambda i, j: f'avg(t{i} * t{j}) AS q{i}{j}', pairs)} FROM {rows} GROUP BY {key}),
        {name}_v AS (SELECT {key}, m0, m1, m2, m3, {many(lambda i, j: f'q{i}{j} - m{i} * m{j} AS v{i}{j}', pairs)} FROM {name}_s),
        {name}_0 AS (
            SELECT {key}, m0, m1, m2, m3, {many(lambda i: f'{live(i)}::INTEGER AS live{i}', index)}, 1::DOUBLE AS det,
                   {many(lambda i, j: f"CASE WHEN {live(i)} AND {live(j)} THEN v{i}{j}{' * (1 + 1e-9::DOUBLE)' if i == j else ''} ELSE {int(i == j)} END AS a{i}{j}", pairs)}
            FROM {name}_v)""")
        for pivot in index:  # invert by eliminating one coordinate after another
            new = []
            for i, j in pairs:
                a, at = cell("a", i, j), f"a{pivot}{pivot}"
                if i == j == pivot:
                    new.append(f"-1 / {at} AS {a}")
                elif pivot in (i, j):
                    new.append(f"{a} / {at} AS {a}")
                else:
                    new.append(f"{a} - {cell('a', i, pivot)} * {cell('a', pivot, j)} / {at} AS {a}")
            steps.append(f"""
        {name}_{pivot + 1} AS (SELECT {key}, m0, m1, m2, m3, live0, live1, live2, live3, det * a{pivot}{pivot} AS det, {', '.join(new)} FROM {name}_{pivot})""")
        steps.append(f"""
        {name} AS MATERIALIZED (SELECT {key}, m0, m1, m2, m3, det, live0 + live1 + live2 + live3 AS dims, {many(lambda i, j: f'-a{i}{j} * live{i} * live{j} AS p{i}{j}', pairs)} FROM {name}_4)""")

    def brought(name: str, from_: str) -> None:
        steps.append(f"""
        {name}_d AS (SELECT grp, quantile_disc({distance}, 0.5) AS middle FROM members JOIN {from_} USING (grp) GROUP BY grp),
        {name} AS MATERIALIZED (
            SELECT grp, dims, m0, m1, m2, m3, {many(lambda i, j: f'p{i}{j} * CASE WHEN middle > 0 THEN coalesce({median_of}[dims], 1) / middle ELSE 1 END AS p{i}{j}', pairs)}
            FROM {from_} JOIN {name}_d USING (grp))""")

    estimate("shaped", "drawn", "key")
    steps.append(f"""
        e0 AS (
            SELECT key, {many(lambda i: f'0::DOUBLE AS m{i}', index)}, {many(lambda i, j: f'p{i}{j}', pairs)} FROM shaped UNION ALL
            SELECT DISTINCT grp || '#0', 0, 0, 0, 0, {many(lambda i, j: str(int(i == j)), pairs)} FROM members)""")
    for k in range(4):
        steps.append(f"""
        b{k} AS MATERIALIZED (SELECT r.*, CAST(floor(ln({distance} + 1e-3) / 0.01) AS BIGINT) AS bin FROM tried r JOIN e{k} USING (key)),
        g{k} AS (SELECT key, quantile_disc(bin, 0.75) AS edge FROM b{k} GROUP BY key),
        core{k} AS (SELECT b{k}.* FROM b{k} JOIN g{k} USING (key) WHERE bin <= edge)""")
        estimate(f"e{k + 1}", f"core{k}", "key")
    steps.append("""
        chosen AS (
            SELECT * FROM (SELECT *, regexp_replace(key, '#[0-9]+$', '') AS grp FROM e4)
            QUALIFY row_number() OVER (PARTITION BY grp ORDER BY dims DESC, det, key) = 1)""")
    brought("raw", "chosen")
    steps.append(f"""
        inner_texts AS (SELECT m.* FROM members m JOIN raw USING (grp) WHERE {distance} <= coalesce({most_of}[dims], 1))""")
    estimate("reweighted", "inner_texts", "grp")
    brought("final", "reweighted")
    return "WITH " + ",".join(steps) + f"""
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND coalesce({distance} <= coalesce({cutoff_of}[dims], 1), true) AS kept
        FROM located LEFT JOIN final USING (grp)"""


def url_sql(rules: list[tuple[str, str]]) -> str:
    """Rules by rank, then both propagations with their steps written out."""
    u = url_trust
    link = u.LINK.replace("'", "''")
    listed = ", ".join(f"({_text(text)}, {_text(text.partition('/')[0])}, {_text('/' + text.partition('/')[2])}, {_text(verdict)})" for text, verdict in rules)
    lower = lambda c: f"translate({c}, '{u.UPPER}', '{u.LOWER}')"
    url = u.URL.replace("'", "''")
    steps = [f"""
        placed AS (
            SELECT row_number() OVER () AS row, page_id, {lower(f"regexp_extract(coalesce(url, ''), '{url}', 1)")} AS host,
                   regexp_extract(coalesce(url, ''), '{url}', 2) AS path, html FROM pages),
        rules(rule, name, start, verdict) AS (VALUES {listed}),
        ruled AS MATERIALIZED (
            SELECT row, page_id, host, path, rule, verdict FROM placed LEFT JOIN (
                SELECT row, rule, verdict FROM (
                    SELECT row, rule, verdict, row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC, verdict = '{u.BLOCK}' DESC, rule) AS r
                    FROM placed JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) WHERE r = 1) USING (row)),
        hosts AS (SELECT host, count(*) AS n, count(*) FILTER (verdict = '{u.ALLOW}') AS allowed, count(*) FILTER (verdict = '{u.BLOCK}') AS blocked
                  FROM ruled WHERE host <> '' GROUP BY host),
        links AS MATERIALIZED (
            SELECT host AS a, b, count(*) AS n FROM (
                SELECT host, {lower('unnest(' + f"regexp_extract_all(html, '{link}', 1)" + ')')} AS b FROM placed WHERE host <> '') WHERE host <> b GROUP BY 1, 2)"""]
    for name, seed, edges in (("t", "allowed", "SELECT a, b, n FROM links"), ("d", "blocked", "SELECT b AS a, a AS b, n FROM links")):
        steps.append(f"""
        {name}_edges AS MATERIALIZED (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS share FROM ({edges})),
        {name}_seeds AS MATERIALIZED (SELECT host, {seed} / n * {1 - u.DAMPING!r}::DOUBLE AS part FROM hosts),
        {name}0 AS (SELECT host, part AS score FROM {name}_seeds)""")
        for k in range(u.STEPS):
            steps.append(f"""
        {name}{k + 1} AS MATERIALIZED (SELECT host, sum(part) AS score FROM (
            SELECT * FROM {name}_seeds UNION ALL
            SELECT b, score * share * {u.DAMPING!r}::DOUBLE FROM {name}_edges JOIN {name}{k} ON host = a) GROUP BY host)""")
    return "WITH " + ",".join(steps) + f"""
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0) > {u.THRESHOLD!r}::DOUBLE
                                                           THEN '{u.BLOCK}' ELSE '{u.ALLOW}' END) AS verdict
        FROM ruled LEFT JOIN d{u.STEPS} d USING (host) LEFT JOIN t{u.STEPS} t USING (host)"""


def license_sql(notices: list[tuple[int, str]]) -> str:
    """From the definition: all shingles of all texts against those of all templates, counted by window."""
    words = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"""
        WITH t AS (
            SELECT id, w, len(w) AS size, least(5, len(w)) AS k, greatest(1, len(w) // 2) AS step
            FROM (SELECT id, {words.format('notice')} AS w FROM (VALUES {', '.join(f'({i}, {_text(n)})' for i, n in notices)}) AS v(id, notice))),
        wanted AS (SELECT *, list_distinct(list_transform(range(1, size - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS own FROM t),
        own AS (SELECT id, size, k, step, len(own) AS total, unnest(own) AS shingle FROM wanted),
        docs AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS d FROM documents),
        said AS (
            SELECT doc_id, n, k, i AS pos, array_to_string(d[i + 1:i + k], ' ') AS shingle FROM (
                SELECT doc_id, d, len(d) AS n, k, unnest(range(0, len(d) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM t))),
        placed AS (
            SELECT doc_id, n, id, size, step, total, shingle,
                   unnest(range(greatest(0, (pos + k - size) // step), pos // step + 1)) * step AS first_word
            FROM said JOIN own USING (k, shingle)),
        held AS (
            SELECT doc_id, id AS template_id, first_word, count(DISTINCT shingle) * 1.0 / any_value(total) AS contained
            FROM placed WHERE first_word + size <= n OR first_word = 0 GROUP BY 1, 2, 3)
        SELECT doc_id, CAST(template_id AS BIGINT) AS template_id, CAST(first_word AS INTEGER) AS first_word, CAST(contained AS DOUBLE) AS contained FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id, template_id ORDER BY contained DESC, first_word) AS r FROM held WHERE contained >= 0.8)
        WHERE r = 1"""
