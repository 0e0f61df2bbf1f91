"""The SQL that says, for a second engine, what each query of the catalog returns."""

from __future__ import annotations

from ..functions.checks import Options
from .catalog import DAILY, DENSE, HOURLY, PERIOD_SIZE, RATE, ROUNDS, SPECTRUM, VECTORS

EVENTS = """SELECT event_type AS series, date_trunc('hour', ts) AS time, round(avg(value), 6) AS value,
  CASE WHEN count(*) >= 2 THEN 'good' ELSE 'bad' END AS quality FROM events GROUP BY 1, 2"""
QUANTITY = "SELECT '' AS series, date_trunc('day', l_shipdate) AS time, sum(l_quantity) AS value, 'good' AS quality FROM lineitem GROUP BY 2"
PRICE = "SELECT '' AS series, date_trunc('day', o_orderdate) AS time, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS value, 'good' AS quality FROM orders GROUP BY 2"


def r(name: str, digits: int = 6, to: str | None = None) -> str:
    return f"round({name} + 1e-9, {digits}) + 0.0 AS {to or name}"


def scale() -> str:
    return "greatest(1.4826 * mad, 2.220446049250313e-16 * greatest(1.0, abs(baseline)))"


def first_stage(source: str, unit: str, given: dict, policy: str = "exclude_suspicious") -> list[tuple[str, str]]:
    """Named steps from raw rows to scored windows."""
    o = Options(**given)
    policy = given.get("history_policy", policy)
    w, step, gap = o.window_size, o.step, o.max_interpolation_gap
    taper = f"(0.5 - 0.5 * cos(2 * pi() * (pos - window_id * {step}) / {w - 1}))"
    median = f"CASE WHEN len(past) >= {o.min_history} THEN list_aggregate(past, 'median') END"
    spread = f"CASE WHEN len(past) >= {o.min_history} THEN list_aggregate(list_transform(past, lambda x: abs(x - baseline)), 'median') END"
    steps = [
        ("raw", source),
        ("prepared", "SELECT series, time, CASE WHEN quality IN ('good') THEN value END AS signal, value IS NOT NULL AND quality IN ('good') AS observed FROM raw"),
        ("grids", f"SELECT series, min(time) AS t0, date_diff('{unit}', min(time), max(time)) + 1 AS n FROM prepared GROUP BY 1"),
        ("places", "SELECT series, t0, unnest(range(n)) AS pos FROM grids"),
        ("regular", f"SELECT p.series, p.pos, p.t0 + to_{unit}s(p.pos::INTEGER) AS time, o.signal, coalesce(o.observed, false) AS observed FROM places p LEFT JOIN prepared o ON o.series = p.series AND o.time = p.t0 + to_{unit}s(p.pos::INTEGER)"),
        ("runs", "SELECT series, min(pos)::BIGINT AS run_start, (max(pos) + 1)::BIGINT AS run_stop FROM (SELECT series, pos, pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS island FROM regular WHERE signal IS NULL) GROUP BY series, island"),
        ("beside", """SELECT *, max(CASE WHEN signal IS NOT NULL THEN pos END) OVER (PARTITION BY series ORDER BY pos ROWS UNBOUNDED PRECEDING) AS a,
            min(CASE WHEN signal IS NOT NULL THEN pos END) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM regular"""),
        ("filled", f"""SELECT z.series, z.pos, z.time, z.signal, z.observed, coalesce(z.signal IS NULL AND b - a - 1 <= {gap}, false) AS interpolated,
            CASE WHEN z.signal IS NOT NULL THEN z.signal WHEN b - a - 1 <= {gap} THEN (y.signal - x.signal) / (b - a) * (z.pos - a) + x.signal END AS filled
            FROM beside z LEFT JOIN regular x ON x.series = z.series AND x.pos = a LEFT JOIN regular y ON y.series = z.series AND y.pos = b"""),
        ("ids", f"SELECT series, unnest(range((n - {w}) // {step} + 1)) AS window_id FROM grids WHERE n >= {w}"),
        ("members", f"SELECT f.*, window_id FROM filled f JOIN ids i ON f.series = i.series AND f.pos BETWEEN window_id * {step} AND window_id * {step} + {w - 1}"),
        ("lost", """SELECT series, window_id, max(n) AS run FROM (SELECT series, window_id, count(*) AS n FROM
            (SELECT series, window_id, pos - row_number() OVER (PARTITION BY series, window_id ORDER BY pos) AS island FROM members WHERE NOT observed) GROUP BY series, window_id, island) GROUP BY 1, 2"""),
        ("counted", """SELECT series, window_id, min(time) AS start_time, max(time) AS end_time, count(*) FILTER (observed)::INTEGER AS observed_samples,
            count(*) FILTER (interpolated)::INTEGER AS interpolated_samples, count(filled) AS present, avg(filled) AS mean FROM members GROUP BY 1, 2"""),
        ("judged", f"""SELECT c.*, coalesce(run, 0)::INTEGER AS longest_missing_run, observed_samples / {w}.0 AS valid_ratio,
            nullif(concat_ws(';', CASE WHEN observed_samples / {w}.0 < {o.min_valid_ratio} THEN 'insufficient_valid_ratio' END, CASE WHEN observed_samples < {o.min_valid_samples or 0} THEN 'insufficient_valid_samples' END,
              CASE WHEN coalesce(run, 0) > {gap} THEN 'gap_too_long' END, CASE WHEN present < {w} THEN 'unfilled_missing_values' END), '') AS rejection_reason
            FROM counted c LEFT JOIN lost USING (series, window_id)"""),
        ("weighed", f"""SELECT series, window_id, sum(pow((filled - mean) * {taper}, 2)) / sum(pow({taper}, 2)) AS energy
            FROM members JOIN judged USING (series, window_id) WHERE rejection_reason IS NULL GROUP BY 1, 2"""),
        ("accepted", "SELECT *, row_number() OVER (PARTITION BY series ORDER BY window_id) AS rn FROM weighed"),
    ]
    if policy == "all":
        past = f"list(energy) OVER (PARTITION BY series ORDER BY window_id ROWS BETWEEN {o.history_size} PRECEDING AND 1 PRECEDING)"
        steps += [("pasts", f"SELECT series, window_id, energy, coalesce({past}, []) AS past FROM accepted"), ("based", f"SELECT *, {median} AS baseline FROM pasts"), ("walk", f"SELECT *, {spread} AS mad FROM based")]
    else:
        steps.append(("walk", f"""SELECT series, 0::BIGINT AS rn, NULL::BIGINT AS window_id, NULL::DOUBLE AS energy, NULL::DOUBLE AS baseline, NULL::DOUBLE AS mad, []::DOUBLE[] AS past FROM grids
            UNION ALL SELECT series, rn, window_id, energy, baseline, mad, CASE WHEN coalesce(abs((energy - baseline) / {scale()}) > {o.k}, false) THEN past ELSE list_append(past, energy)[-{o.history_size}:] END
            FROM (SELECT *, {spread} AS mad FROM (SELECT *, {median} AS baseline FROM
              (SELECT w.series, a.rn, a.window_id, a.energy, w.past FROM walk w JOIN accepted a ON a.series = w.series AND a.rn = w.rn + 1)))"""))
    steps += [
        ("scored", f"SELECT series, window_id, energy, baseline, mad, {scale()} AS robust_scale, (energy - baseline) / {scale()} AS score FROM walk WHERE window_id IS NOT NULL AND baseline IS NOT NULL UNION ALL SELECT series, window_id, energy, NULL, NULL, NULL, NULL FROM walk WHERE window_id IS NOT NULL AND baseline IS NULL"),
        ("result", f"""SELECT j.series, j.window_id, start_time, end_time, j.window_id * {step} AS grid_start, j.window_id * {step} + {w} AS grid_stop, {w}::INTEGER AS expected_samples, observed_samples, interpolated_samples,
            valid_ratio, longest_missing_run, rejection_reason IS NULL AS accepted, rejection_reason, energy, baseline, mad, robust_scale, score, coalesce(abs(score) > {o.k}, false) AS suspicious
            FROM judged j LEFT JOIN scored USING (series, window_id)"""),
    ]
    return steps


def second_stage() -> list[tuple[str, str]]:
    """From scored windows to periods and their transforms."""
    p, n, hop = PERIOD_SIZE, SPECTRUM["n_fft"], SPECTRUM["hop_length"]
    left, bins, step = (n - 1) // 2, n // 2 + 1, RATE / n
    hops = "".join(f" JOIN base t{i} ON t{i}.series = t{i - 1}.series AND t{i}.period_id = t{i - 1}.period_id AND t{i}.time_idx = t{i - 1}.time_idx AND t{i}.freq_idx = t{i - 1}.bin" for i in range(1, ROUNDS))
    angle = f"2 * pi() * k * (m - {n // 2}) / {n}"
    return [
        ("odd", "SELECT *, max(grid_stop) OVER (PARTITION BY series ORDER BY grid_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM result WHERE suspicious"),
        ("grouped", "SELECT *, sum(CASE WHEN grid_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY grid_start)::BIGINT AS period_id FROM odd"),
        ("clusters", "SELECT series, period_id, string_agg(window_id::VARCHAR, ',' ORDER BY window_id) AS source_window_ids, min(grid_start)::BIGINT AS anomaly_grid_start, max(grid_stop)::BIGINT AS anomaly_grid_stop FROM grouped GROUP BY 1, 2"),
        ("samples", "SELECT series, pos, min(time) AS time, arg_min(filled, window_id) AS signal, bool_or(observed) AS observed, bool_or(interpolated) AS interpolated FROM members JOIN judged USING (series, window_id) WHERE rejection_reason IS NULL GROUP BY 1, 2"),
        ("spans", f"SELECT c.*, s.pos, s.time, s.signal, s.observed, s.interpolated FROM clusters c LEFT JOIN samples s ON s.series = c.series AND s.pos >= anomaly_grid_start AND s.pos < anomaly_grid_start + {p}"),
        ("metadata", f"""SELECT series, period_id, source_window_ids, anomaly_grid_start, anomaly_grid_stop, anomaly_grid_stop - anomaly_grid_start AS anomaly_samples, anomaly_grid_start AS period_grid_start,
            anomaly_grid_start + {p} AS period_grid_stop, {p}::INTEGER AS period_samples, max(time) FILTER (pos = anomaly_grid_start) AS start_time, max(time) FILTER (pos = anomaly_grid_start + {p - 1}) AS end_time,
            CASE WHEN anomaly_grid_stop - anomaly_grid_start > {p} THEN 'anomaly_group_too_long' WHEN count(pos) < {p} THEN 'insufficient_following_valid_data' END AS rejection_reason FROM spans GROUP BY 1, 2, 3, 4, 5"""),
        ("period", "SELECT s.*, (pos - s.anomaly_grid_start)::INTEGER AS sample, pos < s.anomaly_grid_stop AS anomaly FROM spans s JOIN metadata m USING (series, period_id) WHERE m.rejection_reason IS NULL"),
        ("processed", "SELECT *, signal - avg(signal) OVER (PARTITION BY series, period_id) AS v FROM period"),
        # The periodic Hann window and its derivative: minus the derivative of a cosine of one turn in n points.
        ("shape", f"SELECT m, 0.5 - 0.5 * cos(2 * pi() * m / {n}) AS w, pi() / {n} * sin(2 * pi() * m / {n}) AS dw FROM range({n}) x(m)"),
        ("frames", f"SELECT t AS time_idx, m, w, dw, CASE WHEN j < 0 THEN -j WHEN j > {p - 1} THEN {2 * p - 2} - j ELSE j END AS sample FROM (SELECT t, m, w, dw, t * {hop} + m - {left} AS j FROM shape, range({(p - 1) // hop + 1}) x(t))"),
        ("transform", f"""SELECT series, period_id, k::INTEGER AS freq_idx, time_idx::INTEGER AS time_idx, sum(v * w * cos({angle})) AS re, -sum(v * w * sin({angle})) AS im,
            {RATE} * sum(v * dw * cos({angle})) AS dre, -{RATE} * sum(v * dw * sin({angle})) AS dim FROM processed JOIN frames USING (sample), range({bins}) y(k) GROUP BY 1, 2, 3, 4"""),
        ("phases", f"SELECT *, CASE WHEN sqrt(re * re + im * im) >= {SPECTRUM['gamma']} THEN abs(freq_idx * {step} - (dim * re - dre * im) / (re * re + im * im) / (2 * pi())) END AS f FROM transform"),
        ("base", f"SELECT *, coalesce(least(greatest(round_even(f / {step}, 0), 0), {bins - 1}), -1)::INTEGER AS bin FROM phases UNION ALL SELECT DISTINCT series, period_id, -1, time_idx, 0, 0, 0, 0, NULL, -1 FROM transform"),
        ("mapped", f"SELECT t0.*, t{ROUNDS - 1}.bin AS target_idx FROM base t0{hops} WHERE t0.freq_idx >= 0"),
        ("moved", f"SELECT series, period_id, target_idx AS freq_idx, time_idx, sum(re) * {step} AS re, sum(im) * {step} AS im FROM mapped WHERE target_idx >= 0 GROUP BY 1, 2, 3, 4"),
        ("squeezed", "SELECT t.series, t.period_id, t.freq_idx, t.time_idx, coalesce(m.re, 0.0) AS msst_re, coalesce(m.im, 0.0) AS msst_im FROM transform t LEFT JOIN moved m USING (series, period_id, freq_idx, time_idx)"),
    ]


def whole_signals() -> list[tuple[str, str]]:
    """From filled samples to the transforms of whole signals, told as a period 0 of each series."""
    n, hop = SPECTRUM["n_fft"], SPECTRUM["hop_length"]
    left = (n - 1) // 2
    later = {name: body for name, body in second_stage()}
    transform = later["transform"].replace("SELECT series, period_id,", "SELECT series, 0 AS period_id,").replace("FROM processed JOIN frames USING (sample)", "FROM heard JOIN complete USING (series, time_idx)")
    return [
        ("level", "SELECT series, avg(filled) AS mean FROM filled GROUP BY 1"),
        ("shape", later["shape"]),
        ("places_of", f"SELECT series, n, t AS time_idx, m, w, dw, t * {hop} + m - {left} AS j FROM (SELECT series, n, unnest(range((n - 1) // {hop} + 1)) AS t FROM grids), shape"),
        ("frames", "SELECT series, time_idx, m, w, dw, CASE WHEN j < 0 THEN -j WHEN j > n - 1 THEN 2 * n - 2 - j ELSE j END AS pos FROM places_of"),
        ("heard", "SELECT f.*, z.filled - mean AS v FROM frames f JOIN filled z USING (series, pos) JOIN level USING (series)"),
        ("complete", f"SELECT series, time_idx FROM heard GROUP BY 1, 2 HAVING count(v) = {n}"),
        ("transform", transform),
        *[(name, later[name]) for name in ("phases", "base", "mapped", "moved", "squeezed")],
    ]


def with_steps(steps: list[tuple[str, str]], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in steps) + "\n" + select


def oracle_sql() -> dict[str, str]:
    one, every = first_stage(EVENTS, "hour", HOURLY), first_stage(EVENTS, "hour", HOURLY, "all")
    both = one + second_stage()
    s, p = "series AS event_type", "series AS event_type, period_id"
    spot = "series AS event_type, period_id, freq_idx, time_idx"
    figures = ", ".join([r("energy"), r("baseline"), r("mad"), r("robust_scale"), r("score", 4)])
    hop, step = SPECTRUM["hop_length"], RATE / SPECTRUM["n_fft"]
    whole = f"SELECT {s}, * EXCLUDE (series) REPLACE (round(valid_ratio + 1e-9, 6) + 0.0 AS valid_ratio, round(energy + 1e-9, 6) + 0.0 AS energy, round(baseline + 1e-9, 6) + 0.0 AS baseline, round(mad + 1e-9, 6) + 0.0 AS mad, round(robust_scale + 1e-9, 6) + 0.0 AS robust_scale, round(score + 1e-9, 4) + 0.0 AS score) FROM result"
    scored = f"SELECT {s}, window_id, {figures}, coalesce(abs(score) > {HOURLY['k']}, false) AS suspicious FROM scored"
    taper = f"(0.5 - 0.5 * cos(2 * pi() * (pos - window_id * 12) / {HOURLY['window_size'] - 1}))"
    vectors = f"""WITH vec AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
        part AS (SELECT *, i // 16 AS window_id FROM vec), mean AS (SELECT vec_id, window_id, avg(v) AS mean FROM part GROUP BY 1, 2),
        w AS (SELECT vec_id, window_id, min(i) * 0.5 AS start_time, max(i) * 0.5 AS end_time, count(*)::INTEGER AS observed_samples,
          sum(pow((v - mean) * (0.5 - 0.5 * cos(2 * pi() * (i % 16) / 15)), 2)) / sum(pow(0.5 - 0.5 * cos(2 * pi() * (i % 16) / 15), 2)) AS energy FROM part JOIN mean USING (vec_id, window_id) GROUP BY 1, 2 HAVING count(*) = 16),
        past AS (SELECT *, list(energy) OVER (PARTITION BY vec_id ORDER BY window_id ROWS BETWEEN {VECTORS['history_size']} PRECEDING AND 1 PRECEDING) AS past FROM w)
        SELECT vec_id, window_id::BIGINT AS window_id, start_time::DOUBLE AS start_time, end_time::DOUBLE AS end_time, observed_samples, true AS accepted, {r("energy")}, round(CASE WHEN len(past) >= {VECTORS['min_history']} THEN list_aggregate(past, 'median') END + 1e-9, 6) + 0.0 AS baseline FROM past"""
    days = "SELECT window_id, start_time, end_time, observed_samples, interpolated_samples, longest_missing_run, accepted, rejection_reason, CASE WHEN energy IS NOT NULL THEN printf('%.11e', energy) END AS energy, round(score + 1e-9, 4) + 0.0 AS score, suspicious FROM result"
    traces = (("regularized signal", "filled", "true"), ("observed", "filled", "observed"), ("interpolated", "filled", "interpolated"), ("centered", "centered", "true"))
    said = "CASE WHEN abs(score) >= 999.5 OR abs(score) < 0.00009995 THEN regexp_replace(printf('%.2e', score), '\\.?0+e', 'e') ELSE regexp_replace(printf('%.10f', printf('%.2e', score)::DOUBLE), '\\.?0+$', '') END"
    row = "dense_rank() OVER (PARTITION BY m.series ORDER BY m.window_id)::INTEGER AS plot_row"
    shown = [*one, ("marked", "SELECT series, window_id, score, count(*) OVER (PARTITION BY series) AS many FROM result WHERE suspicious"), ("shown", f"""SELECT m.series, m.window_id, {row}, 'Suspicious window ' || m.window_id || ' — score=' || {said} AS title, 'Energy anomalies (' || many || ' windows)' AS figure_title,
        m.time, m.filled, m.filled - mean AS centered, m.observed, m.interpolated FROM members m JOIN marked k USING (series, window_id) JOIN judged j USING (series, window_id)""")]
    trace = f"SELECT {s}, window_id, plot_row, title, figure_title, '{{}}' AS trace, time AS x, round({{}} + 1e-9, 6) + 0.0 AS y FROM shown WHERE {{}}"
    first = [*one, ("lone", "SELECT series, window_id, suspicious FROM result WHERE accepted ORDER BY series, window_id LIMIT 1"), ("shown", """SELECT m.window_id, 'Window ' || m.window_id || CASE WHEN suspicious THEN ' (suspicious)' ELSE ' (normal)' END AS title,
        m.time, m.filled, m.filled - mean AS centered, m.observed, m.interpolated FROM members m JOIN lone l USING (series, window_id) JOIN judged j USING (series, window_id)""")]
    lone = "SELECT window_id, 1::INTEGER AS plot_row, title, '{}' AS trace, time AS x, round({} + 1e-9, 6) + 0.0 AS y FROM shown WHERE {}"
    m, w1 = "(pos - window_id * 12)", HOURLY["window_size"] - 1
    shapes = {
        "boxcar": "1.0",
        "hamming": f"(0.54 - 0.46 * cos(2 * pi() * {m} / {w1}))",
        "blackman": f"(0.42 - 0.5 * cos(2 * pi() * {m} / {w1}) + 0.08 * cos(4 * pi() * {m} / {w1}))",
        "bartlett": f"(1 - abs(2.0 * {m} / {w1} - 1))",
        "cosine": f"sin(pi() * ({m} + 0.5) / {w1 + 1})",
    }
    tapers = " UNION ALL ".join(f"SELECT j.series AS event_type, j.window_id, '{k}' AS taper, round(e + 1e-9, 6) + 0.0 AS energy FROM judged j LEFT JOIN (SELECT series, window_id, sum(pow((filled - mean) * {v}, 2)) / sum(pow({v}, 2)) AS e FROM members JOIN judged USING (series, window_id) WHERE rejection_reason IS NULL GROUP BY 1, 2) USING (series, window_id)" for k, v in shapes.items())
    plots = [*both, ("drawn", "SELECT series, period_id, row_number() OVER (PARTITION BY series ORDER BY period_id)::INTEGER AS plot_row, 'Fixed-period spectral analysis (' || count(*) OVER (PARTITION BY series) || ' periods)' AS figure_title FROM (SELECT DISTINCT series, period_id FROM period)")]
    spots = f"round(time_idx * {hop} / {RATE} + 1e-9, 6) + 0.0, round(freq_idx * {step} + 1e-9, 6) + 0.0"
    return {
        "q_dedup_keep_first": "SELECT event_type, date_trunc('hour', ts) AS time, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) = 1",
        "q_quality_mask": with_steps(one, f"SELECT {s}, time, signal, observed FROM prepared"),
        "q_period_estimate": "SELECT event_type, floor(median(gap))::BIGINT AS period FROM (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM (SELECT DISTINCT event_type, ts FROM events)) WHERE gap > 0 GROUP BY 1",
        "q_regular_grid": with_steps(one, f"SELECT {s}, pos, time, signal, observed FROM regular"),
        "q_missing_runs": with_steps(one, f"SELECT {s}, run_start, run_stop FROM runs"),
        "q_interpolate": with_steps(one, f"SELECT {s}, pos, {r('filled')}, observed, interpolated FROM filled"),
        "q_window_membership": with_steps(one, f"SELECT {s}, window_id, pos, observed, interpolated FROM members"),
        "q_window_acceptance": with_steps(one, f"SELECT {s}, window_id, observed_samples, interpolated_samples, longest_missing_run, {r('valid_ratio')}, rejection_reason IS NULL AS accepted, rejection_reason FROM judged"),
        "q_window_energy": with_steps(one, f"SELECT {s}, window_id, {r('energy')} FROM judged LEFT JOIN weighed USING (series, window_id)"),
        "q_score_all": with_steps(every, scored),
        "q_score_exclude": with_steps(one, scored),
        "q_detect": with_steps(one, whole),
        "q_window_data": with_steps(one, f"SELECT {s}, window_id, (pos - window_id * 12)::INTEGER AS sample, time, {r('filled', to='signal')}, {r('filled - mean', to='centered')}, {r(f'(filled - mean) * {taper}', to='windowed')}, m.observed, m.interpolated FROM members m JOIN judged j USING (series, window_id) WHERE rejection_reason IS NULL".replace("SELECT series AS", "SELECT m.series AS", 1)),
        "q_top_suspicious": with_steps(one, f"SELECT {s}, window_id, start_time, end_time, {r('energy')}, {r('score', 4)} FROM result WHERE suspicious QUALIFY row_number() OVER (PARTITION BY series ORDER BY window_id) <= 5"),
        "q_plot_suspicious": with_steps(shown, " UNION ALL ".join(trace.format(*x) for x in traces)),
        "q_plot_window": with_steps(first, " UNION ALL ".join(lone.format(*x) for x in traces)),
        "q_tapers": with_steps(one, tapers),
        "q_suspicious_groups": with_steps(both, f"SELECT {p}, source_window_ids, anomaly_grid_start, anomaly_grid_stop FROM clusters"),
        "q_sample_index": with_steps(both, f"SELECT {s}, pos, time, {r('signal')}, observed, interpolated FROM samples"),
        "q_periods": with_steps(both, f"SELECT {p}, source_window_ids, anomaly_grid_start, anomaly_grid_stop, anomaly_samples, period_grid_start, period_grid_stop, period_samples, start_time, end_time, rejection_reason IS NULL AS accepted, rejection_reason FROM metadata"),
        "q_period_samples": with_steps(both, f"SELECT {p}, sample, time, {r('signal')}, observed, interpolated, anomaly FROM period"),
        "q_stft": with_steps(both, f"SELECT {spot}, {r(f'freq_idx * {step}', to='frequency')}, {r(f'time_idx * {hop} / {RATE}', to='spectral_time')}, {r('re', to='stft_re')}, {r('im', to='stft_im')} FROM transform"),
        "q_freq_map": with_steps(both, f"SELECT {spot}, target_idx FROM mapped"),
        "q_msst": with_steps(both, f"SELECT {spot}, {r('msst_re')}, {r('msst_im')}, {r('sqrt(msst_re * msst_re + msst_im * msst_im)', to='magnitude')} FROM squeezed"),
        "q_plot_msst": with_steps(plots, f"""SELECT {p}, plot_row, 'Period ' || period_id || ' — signal' AS title, figure_title, 'signal' AS panel, 'processed signal' AS trace, time, NULL::DOUBLE AS x, {r('v', to='y')}, NULL::DOUBLE AS z FROM processed JOIN drawn USING (series, period_id)
            UNION ALL SELECT {p}, plot_row, 'Period ' || period_id || ' — signal', figure_title, 'signal', 'anomaly extent', time, NULL, round(v + 1e-9, 6) + 0.0, NULL FROM processed JOIN drawn USING (series, period_id) WHERE anomaly
            UNION ALL SELECT {p}, plot_row, 'Period ' || period_id || ' — STFT', figure_title, 'stft', 'stft magnitude', NULL, {spots}, round(sqrt(re * re + im * im) + 1e-9, 6) + 0.0 FROM transform JOIN drawn USING (series, period_id)
            UNION ALL SELECT {p}, plot_row, 'Period ' || period_id || ' — MSST', figure_title, 'msst', 'msst magnitude', NULL, {spots}, round(sqrt(msst_re * msst_re + msst_im * msst_im) + 1e-9, 6) + 0.0 FROM squeezed JOIN drawn USING (series, period_id)"""),
        "q_daily_quantity": with_steps(first_stage(QUANTITY, "day", DAILY), days),
        "q_daily_price": with_steps(first_stage(PRICE, "day", DAILY), days),
        "q_vector_series": vectors,
        "q_dense_windows": with_steps(first_stage(EVENTS, "hour", DENSE), whole),
        "q_signal_msst": with_steps(one + whole_signals(), f"SELECT series AS event_type, freq_idx, time_idx::BIGINT AS time_idx, {r('t.re', to='stft_re')}, {r('t.im', to='stft_im')}, {r('msst_re')}, {r('msst_im')}, target_idx FROM transform t JOIN squeezed USING (series, period_id, freq_idx, time_idx) JOIN mapped USING (series, period_id, freq_idx, time_idx)"),
        "q_detect_stream": with_steps(one, whole),
    }
