"""The same questions as plain SQL over the driver's tables, to check results by."""

from __future__ import annotations

import re

# Shared parts, each a named subquery. Later ones may use earlier ones.
PARTS: dict[str, str] = {}
PARTS["domains"] = """
SELECT * FROM (VALUES
  ('bdefs', 0, 0, 'Time Management', 3),
  ('bdefs', 0, 1, 'Organisation & Problem-Solving', 3),
  ('bdefs', 0, 2, 'Self-Restraint', 3),
  ('bdefs', 0, 3, 'Self-Motivation', 3),
  ('bdefs', 0, 4, 'Emotion Regulation', 3),
  ('bisbas', 1, 0, 'Behavioral Inhibition (BIS)', 5),
  ('bisbas', 1, 1, 'BAS Drive', 5),
  ('bisbas', 1, 2, 'BAS Reward Responsiveness', 5),
  ('bisbas', 1, 3, 'BAS Fun Seeking', 5)) AS t(type, type_no, domain_no, domain, items)"""
PARTS["fx_tasks"] = """
SELECT CAST(floor(o_orderkey / 4) AS BIGINT) % 100 AS user_id, o_orderkey AS id,
       concat('task ', CAST(o_orderkey AS VARCHAR)) AS title,
       CASE o_orderkey % 4 WHEN 1 THEN o_orderkey - 1 WHEN 2 THEN o_orderkey - 1 WHEN 3 THEN o_orderkey - 3 END AS parent_id,
       CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'active' ELSE 'done' END AS status,
       o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS completed_at
FROM orders"""
PARTS["fx_activity"] = """
SELECT event_id, user_id, ts,
       CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'focus' WHEN 'view' THEN 'activate'
                       WHEN 'signup' THEN 'add' ELSE 'reopen' END AS kind,
       CASE WHEN event_type <> 'click' THEN user_id * 10 + event_id % 3 END AS task_id,
       CASE WHEN event_type = 'click' THEN CAST(floor(value) AS INTEGER) END AS duration_minutes
FROM events"""
PARTS["fx_log"] = """
SELECT event_id, user_id, ts, kind, task_id FROM fx_activity WHERE kind <> 'focus'"""
PARTS["fx_daily"] = """
SELECT user_id, CAST(ts AS DATE) AS date,
       count(*) FILTER (WHERE kind = 'complete') AS tasks_completed,
       CAST(coalesce(sum(duration_minutes) FILTER (WHERE kind = 'focus'), 0) AS BIGINT) AS focus_minutes
FROM fx_activity
WHERE kind = 'complete' OR (kind = 'focus' AND duration_minutes BETWEEN 1 AND 120)
GROUP BY user_id, CAST(ts AS DATE)"""
PARTS["fx_sessions"] = """
SELECT user_id, event_id AS id, CASE WHEN event_id % 3 <> 0 THEN user_id * 4 + event_id % 11 END AS task_id,
       duration_minutes, ts AS completed_at
FROM fx_activity WHERE kind = 'focus' AND duration_minutes BETWEEN 1 AND 120"""
PARTS["fx_answers"] = """
SELECT o.o_orderkey * 3 + d.type_no AS assessment_id, o.o_custkey AS user_id, o.o_orderdate AS taken_at,
       d.type, d.domain_no, d.domain, i.item_no,
       CASE WHEN d.type = 'bdefs' AND o.o_orderkey % 30 = 0 THEN 1
            ELSE CAST(least(4, greatest(1, (o.o_custkey * 7 + o.o_orderkey) % 6 + (d.domain_no * 11 + o.o_orderkey) % 2
                 + (o.o_orderkey * 31 + (d.domain_no * d.items + i.item_no) * 17) % 3 - 1)) AS INTEGER) END AS response
FROM orders o, domains d, (VALUES (0), (1), (2), (3), (4)) AS i(item_no)
WHERE i.item_no < d.items"""
PARTS["fx_trials"] = """
SELECT o.o_orderkey * 3 + 2 AS assessment_id, o.o_custkey AS user_id, o.o_orderdate AS taken_at, t.trial_no,
       c1.colour AS word, c2.colour AS ink_colour,
       CASE WHEN (o.o_orderkey * 17 + t.trial_no * 29) % 10 < 4 + o.o_custkey % 7
            THEN concat(' ', upper(c2.colour)) ELSE c1.colour END AS answer,
       CAST(500 + (o.o_custkey * 37) % 2000 + (t.trial_no * 53) % 200 AS INTEGER) AS elapsed_ms
FROM orders o, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS t(trial_no)
JOIN (VALUES (0, 'red'), (1, 'green'), (2, 'blue'), (3, 'yellow')) AS c2(n, colour) ON c2.n = (o.o_orderkey + t.trial_no) % 4
JOIN (VALUES (0, 'red'), (1, 'green'), (2, 'blue'), (3, 'yellow')) AS c1(n, colour)
  ON c1.n = (o.o_orderkey + t.trial_no + (o.o_orderkey * t.trial_no + 1) % 4) % 4"""
PARTS["fx_domain_scores"] = """
SELECT assessment_id AS id, user_id, type, taken_at, domain_no, domain, CAST(sum(response) AS INTEGER) AS domain_score
FROM fx_answers GROUP BY assessment_id, user_id, type, taken_at, domain_no, domain"""
PARTS["fx_questionnaires"] = """
SELECT id, user_id, type, taken_at, CAST(sum(domain_score) AS INTEGER) AS score,
       CASE type WHEN 'bdefs' THEN 60 ELSE 80 END AS max_score,
       '{' || string_agg('"' || domain || '":' || domain_score, ',' ORDER BY domain_no) || '}' AS domain_scores,
       CAST(NULL AS INTEGER) AS avg_time_ms,
       max(CASE WHEN type = 'bisbas' AND domain_no = 0 THEN domain_score END) AS bis,
       max(CASE WHEN type = 'bisbas' AND domain_no = 1 THEN domain_score END) AS drive,
       max(CASE WHEN type = 'bisbas' AND domain_no = 2 THEN domain_score END) AS reward,
       max(CASE WHEN type = 'bisbas' AND domain_no = 3 THEN domain_score END) AS fun
FROM fx_domain_scores GROUP BY id, user_id, type, taken_at"""
PARTS["fx_stroop"] = """
SELECT id, user_id, type, taken_at, score, max_score,
       '{"correct":' || score || ',"trials":' || max_score || ',"avg_time_ms":' || avg_time_ms || '}' AS domain_scores,
       avg_time_ms, CAST(NULL AS INTEGER) AS bis, CAST(NULL AS INTEGER) AS drive,
       CAST(NULL AS INTEGER) AS reward, CAST(NULL AS INTEGER) AS fun
FROM (SELECT assessment_id AS id, user_id, 'stroop' AS type, taken_at,
             CAST(count(*) FILTER (WHERE lower(trim(answer)) = ink_colour) AS INTEGER) AS score,
             CAST(count(*) AS INTEGER) AS max_score,
             CAST(sum(elapsed_ms) // count(*) AS INTEGER) AS avg_time_ms
      FROM fx_trials WHERE word <> ink_colour GROUP BY assessment_id, user_id, taken_at) s"""
PARTS["fx_results"] = """
SELECT * FROM fx_questionnaires UNION ALL SELECT * FROM fx_stroop"""
PARTS["fx_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY taken_at DESC, id DESC) AS rn FROM fx_results"""
PARTS["fx_latest"] = """
SELECT u.user_id, d.id AS bdefs_id, d.score AS bdefs_score, d.max_score AS bdefs_max, d.taken_at AS bdefs_taken_at,
       s.id AS stroop_id, s.score AS stroop_score, s.max_score AS stroop_max, s.taken_at AS stroop_taken_at, s.avg_time_ms,
       b.id AS bisbas_id, b.score AS bisbas_score, b.taken_at AS bisbas_taken_at, b.bis, b.drive, b.reward, b.fun
FROM (SELECT DISTINCT user_id FROM fx_results) u
LEFT JOIN (SELECT * FROM fx_ranked WHERE rn = 1 AND type = 'bdefs') d ON d.user_id = u.user_id
LEFT JOIN (SELECT * FROM fx_ranked WHERE rn = 1 AND type = 'stroop') s ON s.user_id = u.user_id
LEFT JOIN (SELECT * FROM fx_ranked WHERE rn = 1 AND type = 'bisbas') b ON b.user_id = u.user_id"""
PARTS["fx_domain_all"] = """
SELECT id, user_id, type, domain AS domain, domain_score FROM fx_domain_scores
UNION ALL SELECT id, user_id, type, 'correct', score FROM fx_stroop
UNION ALL SELECT id, user_id, type, 'trials', max_score FROM fx_stroop
UNION ALL SELECT id, user_id, type, 'avg_time_ms', avg_time_ms FROM fx_stroop"""
PARTS["fx_banded"] = """
SELECT *, CASE WHEN type = 'bdefs' THEN domain_score / 12 * 100
               ELSE greatest(domain_score - 5, 0) / 15 * 100 END AS pct,
       CASE WHEN type = 'bdefs' THEN
              CASE WHEN domain_score <= 3 THEN 'minimal' WHEN domain_score <= 6 THEN 'mild' WHEN domain_score <= 9 THEN 'moderate' ELSE 'high' END
            ELSE CASE WHEN greatest(domain_score - 5, 0) / 15 * 100 <= 50 THEN 'low'
                      WHEN greatest(domain_score - 5, 0) / 15 * 100 <= 75 THEN 'moderate' ELSE 'high' END END AS band
FROM fx_domain_scores"""
PARTS["fx_pct"] = """
SELECT *, greatest(bis - 5, 0) / 15 * 100 AS bis_pct, greatest(drive - 5, 0) / 15 * 100 AS drive_pct,
       greatest(reward - 5, 0) / 15 * 100 AS reward_pct, greatest(fun - 5, 0) / 15 * 100 AS fun_pct,
       greatest(score - 20, 0) / 60 * 100 AS whole_pct
FROM fx_questionnaires WHERE type = 'bisbas'"""
PARTS["fx_codes"] = """
SELECT id, concat_ws('|',
         CASE WHEN bis_pct >= 75 THEN 'bis_high' WHEN bis_pct <= 40 THEN 'bis_low_to_moderate' ELSE 'bis_moderate' END,
         CASE WHEN drive_pct >= 75 THEN 'drive_strong' WHEN drive_pct <= 50 THEN 'drive_low' ELSE 'drive_moderate' END,
         CASE WHEN reward_pct >= 75 THEN 'reward_strong' WHEN reward_pct <= 50 THEN 'reward_weak' END,
         CASE WHEN fun_pct >= 75 THEN 'fun_strong' WHEN fun_pct <= 50 THEN 'fun_weak' END,
         CASE WHEN whole_pct <= 33 THEN 'overall_low' WHEN whole_pct >= 66 THEN 'overall_high' ELSE 'overall_moderate' END) AS codes
FROM fx_pct"""

# Raw percentages, out of 20: 15 is 75 percent and 10 is 50 percent.
_FLAGS = """
SELECT *, coalesce(bis >= 15, false) AS anxious, coalesce(drive <= 10, false) AS slack,
       coalesce(drive >= 15, false) AS keen, coalesce(reward >= 15, false) AS rewarded, coalesce(fun >= 15, false) AS playful
FROM {source}"""
_PROFILE = """
SELECT {keep},
       CASE WHEN playful THEN least(f, 12) ELSE f END AS focus_minutes,
       CASE WHEN playful THEN greatest(b, 6) ELSE b END AS break_minutes,
       CASE WHEN anxious THEN 'reassuring' WHEN rewarded OR keen THEN 'reward' ELSE 'balanced' END AS nudge_style,
       anxious OR slack AS suggest_breakdown, rewarded OR keen AS encourage_reward, anxious AS add_reassurance
FROM (SELECT *, CASE WHEN keen AND rewarded AND NOT anxious AND NOT slack THEN 20 WHEN anxious OR slack THEN 10 ELSE 15 END AS f,
             CASE WHEN keen AND rewarded AND NOT anxious AND NOT slack THEN 5 WHEN anxious OR slack THEN 6 ELSE 5 END AS b
      FROM {source}) x"""
PARTS["fx_own_flags"] = _FLAGS.format(source="fx_questionnaires") + " WHERE type = 'bisbas'"
PARTS["fx_own_profile"] = _PROFILE.format(keep="id, user_id", source="fx_own_flags")
PARTS["fx_flags"] = _FLAGS.format(source="fx_latest")
PARTS["fx_base_profile"] = _PROFILE.format(
    keep="user_id, bdefs_score, bdefs_max, stroop_score, stroop_max, avg_time_ms", source="fx_flags"
)
PARTS["fx_first_blend"] = """
SELECT user_id, stroop_score / stroop_max * 100 AS acc, avg_time_ms AS ms,
       CASE WHEN p >= 75 THEN focus_minutes - 3 WHEN p >= 50 THEN focus_minutes - 2 WHEN p <= 30 THEN focus_minutes + 2 ELSE focus_minutes END AS f,
       CASE WHEN p >= 75 THEN break_minutes + 2 WHEN p >= 50 THEN break_minutes + 1 ELSE break_minutes END AS b,
       CASE WHEN p >= 75 THEN 'reassuring' ELSE nudge_style END AS style,
       coalesce(p >= 50, false) OR suggest_breakdown AS sb,
       coalesce(p <= 30, false) OR encourage_reward AS er,
       coalesce(p >= 75, false) OR add_reassurance AS ar
FROM (SELECT *, bdefs_score / bdefs_max * 100 AS p FROM fx_base_profile) x"""
PARTS["fx_blended"] = """
SELECT user_id,
       least(25, greatest(8, CASE WHEN weak THEN least(f, 12) WHEN sharp THEN f + 2 ELSE f END)) AS focus_minutes,
       least(12, greatest(4, CASE WHEN weak THEN greatest(b, 6) WHEN sharp THEN greatest(4, b - 1) ELSE b END)) AS break_minutes,
       CASE WHEN weak AND style <> 'reward' THEN 'reassuring' WHEN sharp AND style <> 'reassuring' THEN 'reward' ELSE style END AS nudge_style,
       sb OR weak AS suggest_breakdown, er OR sharp AS encourage_reward, ar OR weak AS add_reassurance
FROM (SELECT *, coalesce(acc < 65 OR ms >= 2200, false) AS weak,
             coalesce(NOT (acc < 65 OR ms >= 2200) AND acc >= 90 AND ms > 0 AND ms <= 1200, false) AS sharp
      FROM fx_first_blend) x"""
PARTS["fx_islands"] = """
SELECT user_id, min(date) AS first_day, max(date) AS last_day, count(*) AS days
FROM (SELECT user_id, date, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS island
      FROM fx_daily WHERE tasks_completed > 0) x
GROUP BY user_id, island"""
PARTS["fx_streak"] = """
SELECT user_id, count(*) AS streak_days
FROM (SELECT user_id, date, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS n,
             max(date) OVER (PARTITION BY user_id) AS last_day
      FROM fx_daily WHERE tasks_completed > 0 AND date <= DATE '2024-01-30') x
WHERE last_day >= DATE '2024-01-29' AND date = last_day - CAST(n - 1 AS INTEGER)
GROUP BY user_id"""
PARTS["fx_status"] = """
SELECT u.user_id,
       coalesce(c.today_tasks, 0) AS today_tasks, coalesce(c.today_minutes, 0) AS today_minutes,
       coalesce(c.week_tasks, 0) AS week_tasks, coalesce(c.week_minutes, 0) AS week_minutes,
       coalesce(s.streak_days, 0) AS streak_days,
       coalesce(t.pending_tasks, 0) AS pending_tasks, coalesce(t.active_tasks, 0) AS active_tasks,
       coalesce(t.done_tasks, 0) AS done_tasks, a.id AS first_active_id, p.id AS first_pending_id
FROM (SELECT user_id FROM fx_daily UNION SELECT user_id FROM fx_tasks) u
LEFT JOIN (SELECT user_id,
                  CAST(sum(CASE WHEN date = DATE '2024-01-30' THEN tasks_completed ELSE 0 END) AS BIGINT) AS today_tasks,
                  CAST(sum(CASE WHEN date = DATE '2024-01-30' THEN focus_minutes ELSE 0 END) AS BIGINT) AS today_minutes,
                  CAST(sum(CASE WHEN date >= DATE '2024-01-29' THEN tasks_completed ELSE 0 END) AS BIGINT) AS week_tasks,
                  CAST(sum(CASE WHEN date >= DATE '2024-01-29' THEN focus_minutes ELSE 0 END) AS BIGINT) AS week_minutes
           FROM fx_daily GROUP BY user_id) c ON c.user_id = u.user_id
LEFT JOIN fx_streak s ON s.user_id = u.user_id
LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE status = 'pending') AS pending_tasks,
                  count(*) FILTER (WHERE status = 'active') AS active_tasks,
                  count(*) FILTER (WHERE status = 'done') AS done_tasks
           FROM fx_tasks GROUP BY user_id) t ON t.user_id = u.user_id
LEFT JOIN fx_first a ON a.user_id = u.user_id AND a.status = 'active'
LEFT JOIN fx_first p ON p.user_id = u.user_id AND p.status = 'pending'"""
PARTS["fx_first"] = """
SELECT user_id, status, id, title FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY created_at, id) AS n
  FROM fx_tasks WHERE status IN ('active', 'pending')) x
WHERE n = 1"""
PARTS["fx_journal"] = """
SELECT e.user_id, c.conv_id * 1000000 + c.entry AS id, c.values_focus, c.challenge_context, c.thoughts_feelings, c.defusion_reframe,
       c.committed_action, e.ts AS created_at
FROM (SELECT conv_id, turn // 5 AS entry,
             max(CASE WHEN turn % 5 = 0 THEN text END) AS values_focus,
             max(CASE WHEN turn % 5 = 1 THEN text END) AS challenge_context,
             max(CASE WHEN turn % 5 = 2 THEN text END) AS thoughts_feelings,
             max(CASE WHEN turn % 5 = 3 THEN text END) AS defusion_reframe,
             max(CASE WHEN turn % 5 = 4 THEN text END) AS committed_action
      FROM conversations GROUP BY conv_id, turn // 5) c
JOIN events e ON e.event_id = c.conv_id"""
PARTS["fx_journal_stripped"] = r"""
SELECT user_id, id, created_at,
       regexp_replace(values_focus, '^\s+|\s+$', '', 'g') AS values_focus,
       regexp_replace(challenge_context, '^\s+|\s+$', '', 'g') AS challenge_context,
       regexp_replace(thoughts_feelings, '^\s+|\s+$', '', 'g') AS thoughts_feelings,
       regexp_replace(defusion_reframe, '^\s+|\s+$', '', 'g') AS defusion_reframe,
       regexp_replace(committed_action, '^\s+|\s+$', '', 'g') AS committed_action
FROM fx_journal"""
PARTS["fx_journal_checked"] = """
SELECT *, concat_ws('|',
    CASE WHEN coalesce(length(values_focus) BETWEEN 1 AND 1500, false) THEN NULL ELSE 'values_focus_length' END,
    CASE WHEN coalesce(length(challenge_context) BETWEEN 1 AND 2500, false) THEN NULL ELSE 'challenge_context_length' END,
    CASE WHEN coalesce(length(thoughts_feelings) BETWEEN 1 AND 2500, false) THEN NULL ELSE 'thoughts_feelings_length' END,
    CASE WHEN coalesce(length(defusion_reframe) BETWEEN 1 AND 2500, false) THEN NULL ELSE 'defusion_reframe_length' END,
    CASE WHEN coalesce(length(committed_action) BETWEEN 1 AND 1500, false) THEN NULL ELSE 'committed_action_length' END) AS reasons
FROM fx_journal_stripped"""
PARTS["fx_lines"] = r"""
SELECT doc_id, CAST(n - 1 AS INTEGER) AS line_no, lines[n] AS line
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n
      FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '(?m)^(.*\.)$', '  - \1 ', 'g'), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS lines
            FROM documents) a) b"""
PARTS["fx_bullets"] = r"""
SELECT doc_id, line_no, message FROM (
  SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare,
         regexp_replace(substring(regexp_replace(line, '^\s+|\s+$', '', 'g'), 3), '^\s+|\s+$', '', 'g') AS message
  FROM fx_lines) x
WHERE starts_with(bare, '- ') AND message <> ''"""
PARTS["fx_pairs"] = """
SELECT a.user_id, a.type, a.id, a.score, a.max_score, b.id AS id2, b.score AS score2, b.max_score AS max2
FROM (SELECT * FROM fx_ranked WHERE rn = 1) a
LEFT JOIN (SELECT * FROM fx_ranked WHERE rn = 2) b ON b.user_id = a.user_id AND b.type = a.type"""
PARTS["fx_timer"] = """
SELECT event_id, user_id % 5 AS user_id, ts, epoch_us(ts) AS us,
       CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'start'
                       WHEN 'click' THEN 'toggle' ELSE 'stop' END AS kind,
       CASE event_type WHEN 'signup' THEN 15 WHEN 'purchase' THEN 25 WHEN 'view' THEN 5 END AS planned_minutes,
       event_type = 'view' AS is_break,
       CASE WHEN event_type IN ('signup', 'purchase') THEN (user_id % 5) * 10 + event_id % 3 END AS task_id
FROM events"""
PARTS["fx_timer_order"] = """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM fx_timer"""
# One row per event with the timer after it (sid .. resumed) and the session it closed (c_*).
PARTS["fx_timer_states"] = """
SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS sid, CAST(NULL AS BIGINT) AS task_id,
       CAST(NULL AS BOOLEAN) AS is_break, CAST(NULL AS INTEGER) AS minutes, CAST(NULL AS BIGINT) AS started,
       CAST(NULL AS BIGINT) AS lft, CAST(NULL AS BIGINT) AS resumed,
       CAST(NULL AS BIGINT) AS c_sid, CAST(NULL AS BIGINT) AS c_task, CAST(NULL AS BOOLEAN) AS c_break,
       CAST(NULL AS INTEGER) AS c_minutes, CAST(NULL AS BIGINT) AS c_started, CAST(NULL AS BIGINT) AS c_ended,
       CAST(NULL AS BIGINT) AS c_active, CAST(NULL AS VARCHAR) AS c_outcome
FROM (SELECT DISTINCT user_id FROM fx_timer) u
UNION ALL
SELECT user_id, e_n,
       CASE WHEN live AND kind = 'stop' THEN NULL WHEN live THEN sid WHEN kind = 'start' THEN event_id END,
       CASE WHEN live AND kind = 'stop' THEN NULL WHEN live THEN task_id WHEN kind = 'start' THEN e_task END,
       CASE WHEN live AND kind = 'stop' THEN NULL WHEN live THEN is_break WHEN kind = 'start' THEN e_break END,
       CASE WHEN live AND kind = 'stop' THEN NULL WHEN live THEN minutes WHEN kind = 'start' THEN e_minutes END,
       CASE WHEN live AND kind = 'stop' THEN NULL WHEN live THEN started WHEN kind = 'start' THEN us END,
       CASE WHEN live AND kind = 'stop' THEN NULL WHEN live AND kind = 'toggle' THEN now_left WHEN live THEN lft
            WHEN kind = 'start' THEN CAST(e_minutes AS BIGINT) * 60000000 END,
       CASE WHEN live AND kind = 'stop' THEN NULL WHEN live AND kind = 'toggle' THEN CASE WHEN resumed IS NULL THEN us END
            WHEN live THEN resumed WHEN kind = 'start' THEN us END,
       CASE WHEN over OR (live AND kind = 'stop') THEN sid END,
       CASE WHEN over OR (live AND kind = 'stop') THEN task_id END,
       CASE WHEN over OR (live AND kind = 'stop') THEN is_break END,
       CASE WHEN over OR (live AND kind = 'stop') THEN minutes END,
       CASE WHEN over OR (live AND kind = 'stop') THEN started END,
       CASE WHEN over THEN resumed + lft WHEN live AND kind = 'stop' THEN us END,
       CASE WHEN over THEN CAST(minutes AS BIGINT) * 60000000 WHEN live AND kind = 'stop' THEN CAST(minutes AS BIGINT) * 60000000 - now_left END,
       CASE WHEN over THEN 'completed' WHEN live AND kind = 'stop' THEN 'stopped' END
FROM (SELECT s.*, e.n AS e_n, e.event_id, e.us, e.kind, e.planned_minutes AS e_minutes, e.is_break AS e_break, e.task_id AS e_task,
             coalesce(s.resumed + s.lft <= e.us, false) AS over,
             s.sid IS NOT NULL AND NOT coalesce(s.resumed + s.lft <= e.us, false) AS live,
             CASE WHEN s.resumed IS NULL THEN s.lft ELSE s.lft - (e.us - s.resumed) END AS now_left
      FROM fx_timer_states s JOIN fx_timer_order e ON e.user_id = s.user_id AND e.n = s.n + 1) x"""
PARTS["fx_timer_sessions"] = """
SELECT user_id, start_event_id, task_id, is_break, planned_minutes, make_timestamp(started) AS started_at,
       make_timestamp(ended) AS ended_at, outcome, outcome = 'completed' AS completed,
       active // 1000000 AS elapsed_seconds, CAST(planned_minutes AS BIGINT) * 60 AS total_seconds,
       CASE WHEN outcome = 'completed' AND NOT is_break THEN planned_minutes ELSE 0 END AS logged_minutes
FROM (SELECT user_id, c_sid AS start_event_id, c_task AS task_id, c_break AS is_break, c_minutes AS planned_minutes,
             c_started AS started, c_ended AS ended, c_active AS active, c_outcome AS outcome
      FROM fx_timer_states WHERE c_sid IS NOT NULL
      UNION ALL
      SELECT s.user_id, s.sid, s.task_id, s.is_break, s.minutes, s.started, s.resumed + s.lft,
             CASE WHEN s.resumed IS NULL THEN CAST(s.minutes AS BIGINT) * 60000000 - s.lft ELSE CAST(s.minutes AS BIGINT) * 60000000 END,
             CASE WHEN s.resumed IS NULL THEN 'open' ELSE 'completed' END
      FROM fx_timer_states s JOIN (SELECT user_id, max(n) AS n FROM fx_timer_states GROUP BY user_id) m
        ON m.user_id = s.user_id AND m.n = s.n
      WHERE s.sid IS NOT NULL) x"""
# State of every task: the last event after its first add decides.
_FOLD = """
SELECT a.user_id, a.task_id,
       CASE WHEN l.kind IS NULL OR l.kind = 'reopen' THEN 'pending' WHEN l.kind = 'activate' THEN 'active' ELSE 'done' END AS status,
       a.ts AS created_at, CASE WHEN m.kind = 'complete' THEN m.ts END AS completed_at
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, task_id ORDER BY ts, event_id) AS n
                     FROM {log} WHERE kind = 'add') x WHERE n = 1) a
LEFT JOIN (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id, e.task_id ORDER BY e.ts DESC, e.event_id DESC) AS n
           FROM {log} e WHERE e.kind IN ('activate', 'complete', 'reopen')) x WHERE n = 1) l
  ON l.user_id = a.user_id AND l.task_id = a.task_id AND (l.ts, l.event_id) > (a.ts, a.event_id)
LEFT JOIN (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id, e.task_id ORDER BY e.ts DESC, e.event_id DESC) AS n
           FROM {log} e WHERE e.kind IN ('complete', 'reopen')) x WHERE n = 1) m
  ON m.user_id = a.user_id AND m.task_id = a.task_id AND (m.ts, m.event_id) > (a.ts, a.event_id)"""
PARTS["fx_folded"] = _FOLD.format(log="fx_log")
PARTS["fx_focus_log"] = """
SELECT event_id * 2 AS event_id, user_id, ts, kind, task_id FROM fx_log
UNION ALL
SELECT start_event_id * 2 + 1, user_id, started_at, 'activate', task_id FROM fx_timer_sessions
WHERE NOT is_break AND task_id IS NOT NULL"""
PARTS["fx_focus_folded"] = _FOLD.format(log="fx_focus_log")
PARTS["fx_toggle_order"] = """
SELECT l.event_id, l.user_id, l.ts, CASE WHEN l.kind = 'reopen' THEN 'toggle' ELSE l.kind END AS kind, l.task_id,
       row_number() OVER (PARTITION BY l.user_id, l.task_id ORDER BY l.ts, l.event_id) AS n
FROM fx_log l"""
# Walk each task's log event by event; null status: not added yet.
PARTS["fx_toggle_walk"] = """
SELECT user_id, task_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts,
       CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS status
FROM (SELECT DISTINCT user_id, task_id FROM fx_toggle_order) u
UNION ALL
SELECT e.user_id, e.task_id, e.n, e.event_id, e.ts,
       CASE WHEN e.kind = 'toggle' THEN CASE WHEN w.status IS NULL THEN NULL WHEN w.status = 'done' THEN 'reopen' ELSE 'complete' END ELSE e.kind END,
       CASE WHEN w.status IS NULL THEN CASE WHEN e.kind = 'add' THEN 'pending' END
            WHEN e.kind = 'add' THEN w.status
            WHEN e.kind = 'activate' THEN 'active'
            WHEN e.kind = 'complete' OR (e.kind = 'toggle' AND w.status <> 'done') THEN 'done'
            ELSE 'pending' END
FROM fx_toggle_walk w JOIN fx_toggle_order e ON e.user_id = w.user_id AND e.task_id = w.task_id AND e.n = w.n + 1"""
PARTS["fx_roots"] = """
SELECT user_id, id FROM fx_tasks WHERE parent_id IS NULL OR status = 'done'"""
PARTS["fx_below"] = """
SELECT user_id, id, id AS root_id, CAST(0 AS BIGINT) AS depth FROM fx_roots
UNION ALL
SELECT t.user_id, t.id, b.root_id, b.depth + 1
FROM fx_below b JOIN fx_tasks t ON t.user_id = b.user_id AND t.parent_id = b.id
WHERE NOT EXISTS (SELECT 1 FROM fx_roots r WHERE r.user_id = t.user_id AND r.id = t.id)"""
PARTS["fx_doomed"] = """
SELECT user_id, id FROM fx_tasks WHERE status = 'active'
UNION
SELECT t.user_id, t.id FROM fx_doomed b JOIN fx_tasks t ON t.user_id = b.user_id AND t.parent_id = b.id"""
PARTS["fx_before"] = """
SELECT user_id, id, status FROM fx_tasks"""
PARTS["fx_after"] = """
SELECT user_id, id, CASE status WHEN 'active' THEN 'done' ELSE status END AS status FROM fx_tasks WHERE status <> 'done'"""
PARTS["fx_busy"] = """
SELECT DISTINCT user_id FROM fx_daily WHERE tasks_completed >= 3"""

CHECKS: dict[str, str] = {}


def _check(name: str, body: str) -> None:
    """Put the parts that a body needs in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for part in PARTS:
            if part not in needed and re.search(rf"\b{part}\b", text):
                needed.append(part)
                visit(PARTS[part])

    visit(body)
    parts = [p for p in _in_order(needed)]
    head = ",\n".join(f"{p} AS ({PARTS[p]})" for p in parts)
    CHECKS[name] = f"WITH RECURSIVE {head}\n{body.strip()}" if head else body.strip()


def _in_order(names: list[str]) -> list[str]:
    done: list[str] = []

    def place(name: str) -> None:
        if name in done:
            return
        for other in names:
            if other != name and other not in done and re.search(rf"\b{other}\b", PARTS[name]):
                place(other)
        done.append(name)

    for name in names:
        place(name)
    return done


# --- scans, sources, sinks -----------------------------------------------------

_check("scan_tables", """
SELECT 'tasks' AS table_name, count(*) AS stored_rows, count(DISTINCT user_id) AS users, min(user_id) AS lowest_user, max(user_id) AS highest_user FROM fx_tasks
UNION ALL SELECT 'focus_sessions', count(*), count(DISTINCT user_id), min(user_id), max(user_id) FROM fx_sessions
UNION ALL SELECT 'daily_log', count(*), count(DISTINCT user_id), min(user_id), max(user_id) FROM fx_daily
UNION ALL SELECT 'assessments', count(*), count(DISTINCT user_id), min(user_id), max(user_id) FROM fx_results
UNION ALL SELECT 'act_journal_entries', count(*), count(DISTINCT user_id), min(user_id), max(user_id) FROM fx_journal_checked WHERE reasons = ''""")
_TORN = "'{\"id\": ' || id || ', torn'"
_check("decode_tasks", f"""
SELECT CASE WHEN NOT torn THEN user_id END AS user_id, CASE WHEN NOT torn THEN id END AS id,
       CASE WHEN NOT torn THEN title END AS title,
       CASE WHEN NOT torn AND id % 17 <> 4 THEN parent_id END AS parent_id,
       CASE WHEN torn THEN NULL WHEN id % 7 = 3 THEN 'someday' ELSE status END AS status,
       CASE WHEN NOT torn AND id % 11 <> 5 THEN created_at END AS created_at,
       CASE WHEN NOT torn AND id % 13 <> 1 THEN completed_at END AS completed_at,
       CASE WHEN torn THEN 'line' ELSE concat_ws('|', CASE WHEN id % 17 = 4 THEN 'parent_id' END,
            CASE WHEN id % 7 = 3 THEN 'status' END, CASE WHEN id % 11 = 5 THEN 'created_at' END) END AS reasons,
       CASE WHEN NOT torn AND id % 17 = 4 THEN 'zz' END AS raw_parent, CASE WHEN torn THEN {_TORN} END AS raw_line
FROM (SELECT *, id % 19 = 6 AS torn FROM fx_tasks) x""")
_check("decode_sessions", f"""
SELECT CASE WHEN NOT torn THEN user_id END AS user_id, CASE WHEN NOT torn THEN id END AS id,
       CASE WHEN NOT torn AND id % 17 <> 4 THEN duration_minutes END AS duration_minutes,
       CASE WHEN NOT torn AND id % 13 <> 1 THEN ts END AS completed_at,
       CASE WHEN torn THEN 'line' ELSE concat_ws('|', CASE WHEN duration_minutes <= 0 OR id % 17 = 4 THEN 'duration_minutes' END,
                 CASE WHEN id % 13 = 1 THEN 'completed_at' END) END AS reasons,
       CASE WHEN torn THEN {_TORN} END AS raw_line
FROM (SELECT *, event_id AS id, event_id % 19 = 6 AS torn FROM fx_activity WHERE kind = 'focus') x""")
_check("decode_assessments", f"""
SELECT CASE WHEN NOT torn THEN user_id END AS user_id, CASE WHEN NOT torn THEN id END AS id,
       CASE WHEN NOT torn THEN type END AS type, CASE WHEN NOT torn AND id % 17 <> 4 THEN score END AS score,
       CASE WHEN NOT torn THEN max_score END AS max_score, CASE WHEN NOT torn THEN taken_at END AS taken_at,
       CASE WHEN torn OR id % 9 = 2 THEN 0 ELSE domains END AS domains,
       CASE WHEN torn OR id % 9 = 2 THEN NULL ELSE domain_sum END AS domain_sum,
       CASE WHEN torn THEN 'line' ELSE concat_ws('|', CASE WHEN id % 17 = 4 THEN 'score' END,
            CASE WHEN id % 9 = 2 THEN 'domain_scores' END) END AS reasons,
       CASE WHEN torn THEN {_TORN} END AS raw_line
FROM (SELECT r.*, s.domains, s.domain_sum, r.id % 19 = 6 AS torn
      FROM fx_results r JOIN (SELECT id, CAST(count(*) AS INTEGER) AS domains, CAST(sum(domain_score) AS INTEGER) AS domain_sum
                        FROM fx_domain_all GROUP BY id) s ON s.id = r.id) x""")
_check("decode_journal", f"""
SELECT CASE WHEN NOT torn THEN user_id END AS user_id, CASE WHEN NOT torn THEN id END AS id,
       CASE WHEN NOT torn THEN values_focus END AS values_focus,
       CASE WHEN NOT torn AND id % 5 <> 2 THEN created_at END AS created_at,
       CASE WHEN torn THEN 'line' WHEN id % 5 = 2 THEN 'created_at' ELSE '' END AS reasons,
       CASE WHEN torn THEN {_TORN} END AS raw_line
FROM (SELECT *, id % 19 = 6 AS torn FROM fx_journal) x""")
_check("sink_append_tasks", "SELECT user_id, id, title, parent_id, status, created_at, completed_at FROM fx_tasks")
_check("sink_append_assessments", """
SELECT r.user_id, r.id, r.type, r.score, r.max_score, r.taken_at, s.domains
FROM fx_results r JOIN (SELECT id, CAST(count(*) AS INTEGER) AS domains FROM fx_domain_all GROUP BY id) s ON s.id = r.id""")
_check("sink_append_journal", """
SELECT user_id, id, values_focus, committed_action, created_at FROM fx_journal_checked WHERE reasons = ''""")
_check("sink_daily_log", """
SELECT user_id, date, tasks_completed, focus_minutes + CASE WHEN user_id % 2 = 0 THEN 60 ELSE 0 END AS focus_minutes
FROM fx_daily""")
_check("encode_assessments", """
SELECT user_id, id, type, score, max_score, domain_scores, strftime(taken_at, '%Y-%m-%dT%H:%M:%S') AS taken_at
FROM fx_results""")
_check("message_corpus", "SELECT message, count(*) AS n FROM fx_bullets GROUP BY message")
_check("message_corpus_fallback", "SELECT 'fallback ' || lang AS message, count(*) AS n FROM documents GROUP BY lang")
_check("dedup_keep_first", """
SELECT text_hash, doc_id, source, n_chars FROM (
  SELECT sha256(text) AS text_hash, doc_id, source, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n
  FROM documents) x WHERE n = 1""")
_check("sink_append", """
SELECT user_id, row_number() OVER (ORDER BY completed_at, user_id) AS id, task_id, duration_minutes, completed_at
FROM fx_sessions""")

# --- validation ----------------------------------------------------------------

_check("validate_tasks", """
SELECT id, status, concat_ws('|', CASE WHEN length(title) BETWEEN 1 AND 500 THEN NULL ELSE 'title_length' END,
                             CASE WHEN status IN ('pending', 'active', 'done') THEN NULL ELSE 'status_unknown' END) AS reasons
FROM (SELECT doc_id AS id, text AS title,
             CASE lang WHEN 'en' THEN 'pending' WHEN 'fr' THEN 'active' WHEN 'de' THEN 'done' ELSE lang END AS status
      FROM documents) x""")
_check("validate_sessions", """
SELECT event_id, duration_minutes, CASE WHEN duration_minutes BETWEEN 1 AND 120 THEN '' ELSE 'duration_range' END AS reasons
FROM fx_activity WHERE kind = 'focus'""")
_check("validate_daily_log", """
SELECT user_id, date, tasks_completed - 1 AS tasks_completed, focus_minutes - 30 AS focus_minutes,
       concat_ws('|', CASE WHEN tasks_completed - 1 < 0 THEN 'tasks_negative' END,
                 CASE WHEN focus_minutes - 30 < 0 THEN 'minutes_negative' END) AS reasons
FROM fx_daily""")
_check("validate_assessments", """
SELECT id, CASE WHEN user_id % 5 = 0 THEN upper(type) ELSE type END AS type,
       concat_ws('|', CASE WHEN user_id % 5 = 0 THEN 'type_unknown' END, CASE WHEN score - 20 < 0 THEN 'score_negative' END,
                 CASE WHEN max_score - 10 <= 0 THEN 'max_not_positive' END) AS reasons
FROM fx_results""")
_check("validate_journal", "SELECT id, reasons FROM fx_journal_checked")
_check("validate_answers", """
SELECT type, domain, response * 2 - 2 AS response,
       CASE WHEN response * 2 - 2 BETWEEN 1 AND 4 THEN '' ELSE 'response_range' END AS reasons, count(*) AS answers
FROM fx_answers GROUP BY type, domain, response""")
_check("validate_trials", """
SELECT word, ink_colour, CASE WHEN word = ink_colour THEN 'word_is_ink' ELSE '' END AS reasons, count(*) AS trials
FROM fx_trials GROUP BY word, ink_colour""")
_check("validate_timer_plan", """
SELECT event_id, CAST(floor(value) AS INTEGER) AS planned_minutes,
       CASE WHEN CAST(floor(value) AS INTEGER) BETWEEN 1 AND 120 THEN '' ELSE 'plan_range' END AS reasons
FROM events""")

# --- projections, filters, lookups -----------------------------------------------

_check("task_by_id", """
SELECT w.user_id, w.id, t.title, t.parent_id, t.status, t.created_at, t.completed_at
FROM (SELECT DISTINCT user_id, task_id AS id FROM fx_sessions WHERE task_id IS NOT NULL) w
LEFT JOIN fx_tasks t ON t.user_id = w.user_id AND t.id = w.id""")
_check("list_tasks", """
SELECT *, parent_id IS NOT NULL AS is_subtask FROM fx_tasks WHERE status = 'pending'""")
_check("subtasks", """
SELECT c.* FROM fx_tasks c JOIN fx_tasks p ON p.user_id = c.user_id AND p.id = c.parent_id WHERE p.status = 'active'""")
_check("open_count", """
SELECT user_id, count(*) FILTER (WHERE status IN ('active', 'pending')) AS open_tasks FROM fx_tasks GROUP BY user_id""")
_check("daily_log_lookup", """
SELECT u.user_id, q.date, coalesce(d.tasks_completed, 0) AS tasks_completed, coalesce(d.focus_minutes, 0) AS focus_minutes
FROM (SELECT DISTINCT user_id FROM fx_activity) u
CROSS JOIN (VALUES (DATE '2024-01-15'), (DATE '2024-01-30'), (DATE '2024-02-03')) AS q(date)
LEFT JOIN fx_daily d ON d.user_id = u.user_id AND d.date = q.date""")
_check("list_daily_logs", "SELECT * FROM fx_daily")
_check("count_results", "SELECT user_id, count(*) AS results FROM fx_results GROUP BY user_id")

# --- joins -----------------------------------------------------------------------

_check("tasks_by_parent", """
SELECT c.user_id, p.id AS parent_id, p.title AS parent_title, p.status AS parent_status, c.id, c.title, c.status, c.created_at
FROM fx_tasks c JOIN fx_tasks p ON p.user_id = c.user_id AND p.id = c.parent_id
WHERE c.status IN ('active', 'pending')""")
_check("sessions_with_task", """
SELECT s.*, t.title AS task_title, t.status AS task_status
FROM fx_sessions s LEFT JOIN fx_tasks t ON t.user_id = s.user_id AND t.id = s.task_id""")
_check("dangling_parents", """
SELECT c.* FROM fx_tasks c
WHERE c.status <> 'done' AND c.parent_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fx_tasks p WHERE p.user_id = c.user_id AND p.id = c.parent_id AND p.status <> 'done')""")
_check("task_descendants", "SELECT user_id, id, root_id, depth FROM fx_below")
_check("active_days_semi", """
SELECT d.* FROM fx_daily d
WHERE d.tasks_completed > 0 AND d.date <= DATE '2024-01-30'
  AND EXISTS (SELECT 1 FROM fx_daily b WHERE b.user_id = d.user_id AND b.date = d.date - 1 AND b.tasks_completed > 0)""")
_check("advice_lookup", """
SELECT id, type, domain, domain_score, band, concat('advice on ', domain, ': ', band) AS text FROM fx_banded""")
_check("advice_lookup_range", """
SELECT id, type, domain, domain_score, round(pct, 6) AS pct, band FROM fx_banded""")
_check("records_in_windows", """
SELECT s.user_id, s.id, s.completed_at, t.event_id AS start_event_id
FROM fx_sessions s LEFT JOIN fx_timer t ON t.kind = 'start'
     AND epoch_us(s.completed_at) > t.us AND epoch_us(s.completed_at) <= t.us + CAST(t.planned_minutes AS BIGINT) * 1000000""")
_check("latest_three_types", """
SELECT user_id, bdefs_id, bdefs_score, bdefs_taken_at, stroop_id, stroop_score, stroop_taken_at,
       bisbas_id, bisbas_score, bisbas_taken_at FROM fx_latest""")
_check("assessment_asof_session", """
SELECT s.user_id, s.id, s.completed_at, r.id AS result_id, r.taken_at AS result_taken_at, r.score AS result_score
FROM (SELECT user_id, id, completed_at - to_days(CAST(8400 + id % 2300 AS INTEGER)) AS completed_at FROM fx_sessions) s
LEFT JOIN LATERAL (SELECT q.id, q.taken_at, q.score FROM fx_questionnaires q
                   WHERE q.type = 'bisbas' AND q.user_id = s.user_id AND q.taken_at <= s.completed_at
                   ORDER BY q.taken_at DESC, q.id DESC LIMIT 1) r ON true""")

# --- aggregations ------------------------------------------------------------------

_check("daily_activity", "SELECT * FROM fx_daily")
_check("week_totals", """
SELECT user_id, CAST(sum(tasks_completed) AS BIGINT) AS week_tasks_completed, CAST(sum(focus_minutes) AS BIGINT) AS week_focus_minutes
FROM fx_daily WHERE date >= CAST(date_trunc('week', DATE '2024-01-30') AS DATE) GROUP BY user_id""")
_check("streak_days", "SELECT user_id, streak_days FROM fx_streak")
_check("status_summary", "SELECT * FROM fx_status")
_check("status_lists", """
SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY created_at, id) AS position
FROM fx_tasks WHERE status IN ('active', 'pending')""")
_check("status_view", """
SELECT s.*, coalesce(pending, '[]') AS pending, coalesce(active, '[]') AS active FROM fx_status s LEFT JOIN (
    SELECT user_id, CAST(to_json(list({'id': id, 'title': title} ORDER BY created_at, id) FILTER (WHERE status = 'pending')) AS VARCHAR) AS pending,
        CAST(to_json(list({'id': id, 'title': title} ORDER BY created_at, id) FILTER (WHERE status = 'active')) AS VARCHAR) AS active
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY created_at, id) AS n FROM fx_tasks WHERE status <> 'done') t
    WHERE n <= 5 GROUP BY user_id) l ON l.user_id = s.user_id""")
_check("progress_pct", """
SELECT user_id, round(CASE WHEN today_tasks + pending_tasks + active_tasks > 0
                      THEN today_tasks / (today_tasks + pending_tasks + active_tasks) * 100 ELSE 0.0 END, 6) AS progress_pct
FROM fx_status""")
_check("score_questionnaire", """
SELECT id, user_id, type, taken_at, CAST(sum(part) AS INTEGER) AS score, CASE type WHEN 'bdefs' THEN 60 ELSE 80 END AS max_score,
       '{' || string_agg('"' || domain || '":' || part, ',' ORDER BY place) || '}' AS domain_scores
FROM (SELECT assessment_id AS id, user_id, type, taken_at, domain, place, CAST(sum(response) AS BIGINT) AS part
      FROM (SELECT assessment_id, user_id, type, taken_at, response,
                   CASE WHEN assessment_id % 10 = 0 AND item_no = 0 THEN 'Zest' ELSE domain END AS domain,
                   CASE WHEN assessment_id % 10 = 0 AND item_no = 0 THEN 9 ELSE domain_no END AS place FROM fx_answers) a
      GROUP BY ALL) s
GROUP BY id, user_id, type, taken_at""")
_check("score_answer_map", """
SELECT id, user_id, type, taken_at, score, max_score, domain_scores FROM fx_questionnaires""")
_check("max_scores", """
SELECT type, domain, items, items AS floor_score, items * 4 AS max_score, items * 3 AS score_range
FROM (SELECT type, domain, count(*) AS items FROM (SELECT DISTINCT type, domain, item_no FROM fx_answers) x
      GROUP BY GROUPING SETS ((type, domain), (type))) y""")
_check("score_stroop", "SELECT id, user_id, type, taken_at, score, max_score, avg_time_ms FROM fx_stroop")
_check("stroop_accuracy", """
SELECT assessment_id, user_id, count(*) AS trials, count(*) FILTER (WHERE lower(trim(answer)) = ink_colour) AS correct,
       round(count(*) FILTER (WHERE lower(trim(answer)) = ink_colour) / count(*) * 100, 6) AS accuracy_pct,
       round(sum(elapsed_ms) / 1000 / count(*), 6) AS avg_time_s
FROM fx_trials WHERE word <> ink_colour GROUP BY assessment_id, user_id""")
_check("mean_domain_scores", """
SELECT d.user_id, d.domain, round(sum(d.domain_score) / max(n.results), 6) AS mean_score
FROM fx_domain_all d JOIN (SELECT user_id, count(*) AS results FROM fx_results GROUP BY user_id) n ON n.user_id = d.user_id
GROUP BY d.user_id, d.domain""")
_check("activity_rollup", """
SELECT user_id, week, CAST(grouping(user_id) * 2 + grouping(week) AS INTEGER) AS level,
       CAST(sum(tasks_completed) AS BIGINT) AS tasks_completed, CAST(sum(focus_minutes) AS BIGINT) AS focus_minutes
FROM (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week FROM fx_daily) x GROUP BY ROLLUP (user_id, week)""")
_check("band_distribution", """
SELECT b.type, b.domain, b.band, count(*) AS users
FROM fx_banded b JOIN fx_ranked r ON r.id = b.id AND r.rn = 1 GROUP BY b.type, b.domain, b.band""")

# --- windows -----------------------------------------------------------------------

_check("latest_per_type", "SELECT id, user_id, type, taken_at, score, max_score FROM fx_ranked WHERE rn = 1")
_check("latest_vs_previous", """
SELECT user_id, type, id AS latest_id, score AS latest_score, id2 AS previous_id, score2 AS previous_score FROM fx_pairs""")
_check("trend_fit", """
SELECT user_id, id, taken_at, score, points, round(slope, 6) AS slope, round(intercept, 4) AS intercept,
       round(slope * x + intercept, 4) AS fitted
FROM (SELECT *, count(*) OVER w AS points, regr_slope(score, x) OVER w AS slope, regr_intercept(score, x) OVER w AS intercept
      FROM (SELECT *, epoch_us(taken_at) / 86400000000 AS x FROM fx_questionnaires WHERE type = 'bdefs') q
      WINDOW w AS (PARTITION BY user_id)) y
WHERE points >= 2""")
_check("streak_islands", "SELECT * FROM fx_islands")
_check("first_open_task", """
SELECT u.user_id, a.id AS active_id, a.title AS active_title, p.id AS pending_id, p.title AS pending_title
FROM (SELECT DISTINCT user_id FROM fx_tasks) u
LEFT JOIN fx_first a ON a.user_id = u.user_id AND a.status = 'active'
LEFT JOIN fx_first p ON p.user_id = u.user_id AND p.status = 'pending'""")
_check("suggest_next", """
SELECT u.user_id, CASE WHEN a.id IS NOT NULL THEN 'continue' WHEN p.id IS NOT NULL THEN 'start' ELSE 'add_one' END AS action,
       coalesce(a.id, p.id) AS task_id, CASE WHEN a.id IS NOT NULL THEN a.title ELSE p.title END AS title,
       coalesce(f.focus_minutes, 15) AS focus_minutes,
       a.id IS NULL AND p.id IS NOT NULL AND coalesce(f.suggest_breakdown, false) AS break_down_hint
FROM (SELECT user_id FROM fx_tasks UNION SELECT user_id FROM fx_base_profile) u
LEFT JOIN fx_first a ON a.user_id = u.user_id AND a.status = 'active'
LEFT JOIN fx_first p ON p.user_id = u.user_id AND p.status = 'pending'
LEFT JOIN fx_base_profile f ON f.user_id = u.user_id""")
_check("session_gap", """
SELECT *, round((epoch_us(completed_at) - epoch_us(previous_at)) / 60000000, 4) AS gap_minutes
FROM (SELECT *, lag(completed_at) OVER (PARTITION BY user_id ORDER BY completed_at, id) AS previous_at,
             CAST(sum(duration_minutes) OVER (PARTITION BY user_id ORDER BY completed_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_minutes
      FROM fx_sessions) x""")

# --- sorts, limits, sets -------------------------------------------------------------

_check("recent_assessments", """
SELECT id, user_id, type, taken_at, score, max_score, CAST(n AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY taken_at DESC, id DESC) AS n FROM fx_results) x WHERE n <= 20""")
_check("recent_sessions", """
SELECT user_id, id, task_id, duration_minutes, completed_at, CAST(n AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY completed_at DESC, id DESC) AS n FROM fx_sessions) x WHERE n <= 50""")
_check("recent_journal", """
SELECT user_id, id, values_focus, challenge_context, thoughts_feelings, defusion_reframe, committed_action, created_at,
       CAST(n AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n
      FROM fx_journal_checked WHERE reasons = '') x WHERE n <= 20""")
_check("task_board", """
SELECT *, CASE status WHEN 'active' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END AS board_rank FROM fx_tasks""")
_check("task_snapshot_diff", """
SELECT user_id, id, status, change, count(*) AS n FROM (
  SELECT *, 'removed' AS change FROM (SELECT * FROM fx_before EXCEPT ALL SELECT * FROM fx_after) a
  UNION ALL SELECT *, 'added' FROM (SELECT * FROM fx_after EXCEPT ALL SELECT * FROM fx_before) b
  UNION ALL SELECT *, 'same' FROM (SELECT * FROM fx_before INTERSECT ALL SELECT * FROM fx_after) c) x
GROUP BY user_id, id, status, change""")

# --- bands, profiles, nudges -----------------------------------------------------------

_check("bdefs_band", """
SELECT id, score, CASE WHEN score / 60 * 100 <= 25 THEN 'minimal' WHEN score / 60 * 100 <= 50 THEN 'mild'
                       WHEN score / 60 * 100 <= 75 THEN 'moderate' ELSE 'significant' END AS band
FROM fx_questionnaires WHERE type = 'bdefs'""")
_check("domain_band", "SELECT id, domain, domain_score, band FROM fx_banded WHERE type = 'bdefs'")
_check("bisbas_normalise", """
SELECT id, 'total' AS part, greatest(score - 20, 0) AS value, 60 AS value_range FROM fx_questionnaires WHERE type = 'bisbas'
UNION ALL
SELECT id, domain, CASE WHEN type = 'bisbas' THEN greatest(domain_score - 5, 0) ELSE domain_score END,
       CASE WHEN type = 'bisbas' THEN 15 ELSE 0 END
FROM fx_domain_all WHERE type <> 'bdefs'""")
_check("bisbas_domain_band", "SELECT id, domain, domain_score, band FROM fx_banded WHERE type = 'bisbas'")
_check("bisbas_profile_codes", "SELECT id, codes FROM fx_codes")
_check("stroop_codes", """
SELECT id, CASE WHEN score / max_score * 100 >= 90 THEN 'excellent' WHEN score / max_score * 100 >= 70 THEN 'good'
                WHEN score / max_score * 100 >= 50 THEN 'moderate' ELSE 'low' END AS accuracy,
       CASE WHEN avg_time_ms <= 1000 THEN 'fast' WHEN avg_time_ms <= 2000 THEN 'average' ELSE 'slow' END AS speed
FROM fx_stroop""")
_check("bisbas_guidance_codes", """
SELECT p.id, concat_ws('|',
         CASE WHEN bis_pct >= 75 THEN 'bis_high' WHEN bis_pct <= 40 THEN 'bis_low' ELSE 'bis_middle' END,
         CASE WHEN drive_pct <= 50 THEN 'drive_low' WHEN drive_pct >= 75 THEN 'drive_high' END,
         CASE WHEN reward_pct >= 75 THEN 'reward_high' ELSE 'reward_other' END,
         CASE WHEN fun_pct >= 75 THEN 'fun_high' ELSE 'fun_other' END) AS tips,
       f.focus_minutes, f.break_minutes
FROM fx_pct p JOIN fx_own_profile f ON f.id = p.id""")
_check("profile_bisbas", "SELECT * FROM fx_own_profile")
_check("profile_latest_bisbas", """
SELECT user_id, focus_minutes, break_minutes, nudge_style, suggest_breakdown, encourage_reward, add_reassurance FROM fx_base_profile""")
_check("profile_blended", "SELECT * FROM fx_blended")
_check("nudge_style_apply", """
SELECT user_id, nudge_style,
       concat(CASE nudge_style WHEN 'reassuring' THEN 'Gently now. ' WHEN 'reward' THEN 'Well earned. ' ELSE '' END,
              'Hello, user ', CAST(user_id AS VARCHAR)) AS nudge
FROM fx_base_profile""")
_check("act_gate", "SELECT user_id, suggest_breakdown OR add_reassurance AS offered FROM fx_blended")
_check("act_guidance_code", """
SELECT user_id, CASE WHEN suggest_breakdown AND add_reassurance THEN 'both' WHEN add_reassurance THEN 'reassurance'
                     WHEN suggest_breakdown THEN 'breakdown' ELSE 'neither' END AS guidance FROM fx_blended""")
_check("assign_nudge", """
SELECT d.list, d.user_id, d.date, m.number, m.message
FROM (SELECT list, user_id, date, (user_id * 7919 + CAST(date - DATE '1970-01-01' AS BIGINT) * 104729) % n AS number
      FROM fx_daily, (SELECT CASE WHEN line_no % 3 = 0 THEN 'break' ELSE 'nudge' END AS list, count(*) AS n
                      FROM fx_bullets GROUP BY 1) l) d
JOIN (SELECT CASE WHEN line_no % 3 = 0 THEN 'break' ELSE 'nudge' END AS list, message,
             row_number() OVER (PARTITION BY line_no % 3 = 0 ORDER BY doc_id, line_no) - 1 AS number FROM fx_bullets) m
  ON m.number = d.number AND m.list = d.list""")
PARTS["fx_entries"] = """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY taken_at DESC, id DESC) AS n FROM fx_results"""
PARTS["fx_entry_lines"] = """
SELECT id, 'total' AS part, NULL AS name, CASE WHEN type = 'bisbas' THEN greatest(score - 20, 0) ELSE score END AS value,
         CASE WHEN type = 'bisbas' THEN 60 ELSE max_score END AS out_of, NULL AS code FROM fx_entries
  UNION ALL
  SELECT id, 'domain', domain, CASE WHEN type = 'bisbas' THEN greatest(domain_score - 5, 0) ELSE domain_score END,
         CASE WHEN type = 'bisbas' THEN 15 END, band FROM fx_banded WHERE type IN ('bdefs', 'bisbas')
  UNION ALL SELECT id, 'time', NULL, avg_time_ms, NULL, NULL FROM fx_entries WHERE type = 'stroop'
  UNION ALL
  SELECT id, 'reading', NULL, NULL, NULL, unnest(CASE
    WHEN type = 'bisbas' THEN string_split(codes, '|')
    WHEN type = 'bdefs' THEN [CASE WHEN score <= 15 THEN 'minimal' WHEN score <= 30 THEN 'mild'
                                   WHEN score <= 45 THEN 'moderate' ELSE 'significant' END]
    ELSE [CASE WHEN score / max_score * 100 >= 90 THEN 'excellent' WHEN score / max_score * 100 >= 70 THEN 'good'
               WHEN score / max_score * 100 >= 50 THEN 'moderate' ELSE 'low' END,
          CASE WHEN avg_time_ms <= 1000 THEN 'fast' WHEN avg_time_ms <= 2000 THEN 'average' ELSE 'slow' END] END)
  FROM (SELECT r.*, c.codes FROM fx_entries r LEFT JOIN fx_codes c ON c.id = r.id) x"""
_check("history_entries", """
SELECT r.user_id, r.id, CAST(r.n AS INTEGER) AS rank, r.type, r.taken_at, l.part, l.name, CAST(l.value AS INTEGER) AS value,
       CAST(l.out_of AS INTEGER) AS out_of, l.code
FROM fx_entries r JOIN fx_entry_lines l ON l.id = r.id WHERE r.n <= 10""")
_check("radar_vector", """
SELECT r.id, d.domain_no AS place, CAST(coalesce(s.domain_score, 0) AS DOUBLE) AS value
FROM fx_results r JOIN domains d ON d.type = 'bdefs'
LEFT JOIN fx_domain_scores s ON s.id = r.id AND s.domain = d.domain""")
_check("reserve_pct", """
SELECT id, domain_no AS place, round(greatest(12 - domain_score, 0) / 12 * 100, 6) AS reserve
FROM fx_domain_scores WHERE type = 'bdefs'""")
_check("reserve_delta", """
SELECT user_id, id, place, round(now, 6) AS now, round("then", 6) AS "then", domain,
       CASE WHEN "then" IS NULL THEN 'only' WHEN now - "then" > 0.9 THEN 'up' WHEN now - "then" < -0.9 THEN 'down' ELSE 'steady' END AS direction,
       CASE WHEN "then" IS NULL THEN round_even(now, 0) WHEN abs(now - "then") > 0.9 THEN round_even(now - "then", 0) END AS shown
FROM (SELECT p.user_id, p.id, a.domain_no AS place, a.domain, greatest(12 - a.domain_score, 0) / 12 * 100 AS now,
             CASE WHEN b.domain_score IS NOT NULL THEN greatest(12 - b.domain_score, 0) / 12 * 100 END AS "then"
      FROM fx_pairs p JOIN fx_domain_scores a ON a.id = p.id
      LEFT JOIN fx_domain_scores b ON b.id = p.id2 AND b.domain = a.domain
      WHERE p.type = 'bdefs') x""")
_check("reserve_overall", """
SELECT user_id, id, round(reserve, 6) AS reserve, round(reserve_before, 6) AS reserve_before, round(reserve - reserve_before, 6) AS delta,
       CASE WHEN abs(reserve - reserve_before) >= 1 THEN CASE WHEN reserve > reserve_before THEN 'up' ELSE 'down' END END AS direction
FROM (SELECT user_id, id, (max_score - score) / max_score * 100 AS reserve, (max2 - score2) / max2 * 100 AS reserve_before
      FROM fx_pairs WHERE type = 'bdefs') x""")
_check("bisbas_bars", """
SELECT id, domain_no AS place, greatest(domain_score - 5, 0) AS value FROM fx_domain_scores WHERE type = 'bisbas'""")

# --- state changes -------------------------------------------------------------------

_check("fold_task_state", "SELECT * FROM fx_folded")
_check("toggle_task", """
SELECT event_id, user_id, ts, kind, task_id FROM fx_toggle_walk WHERE n > 0 AND kind IS NOT NULL""")
_check("focus_activates_task", "SELECT * FROM fx_focus_folded")
_check("delete_task_cascade", """
SELECT user_id, 'task' AS what, id, parent_id AS link FROM fx_tasks t
WHERE NOT EXISTS (SELECT 1 FROM fx_doomed d WHERE d.user_id = t.user_id AND d.id = t.id)
UNION ALL
SELECT user_id, 'session', id, CASE WHEN EXISTS (SELECT 1 FROM fx_doomed d WHERE d.user_id = s.user_id AND d.id = s.task_id)
                               THEN NULL ELSE task_id END
FROM fx_sessions s""")
_check("delete_all_tasks", """
SELECT user_id, 'tasks' AS what, count(*) AS n FROM fx_tasks WHERE user_id NOT IN (SELECT user_id FROM fx_busy) GROUP BY user_id
UNION ALL SELECT user_id, 'sessions', count(*) FROM fx_sessions WHERE user_id NOT IN (SELECT user_id FROM fx_busy) GROUP BY user_id
UNION ALL SELECT user_id, 'completed', CAST(sum(CASE WHEN user_id IN (SELECT user_id FROM fx_busy) THEN 0 ELSE tasks_completed END) AS BIGINT) FROM fx_daily GROUP BY user_id
UNION ALL SELECT user_id, 'minutes', CAST(sum(focus_minutes) AS BIGINT) FROM fx_daily GROUP BY user_id
UNION ALL SELECT b.user_id, 'deleted', count(t.id) FROM fx_busy b LEFT JOIN fx_tasks t ON t.user_id = b.user_id GROUP BY b.user_id""")
_check("delete_results", """
SELECT user_id, id, 'kept' AS state FROM fx_results WHERE NOT (type = 'stroop' AND score * 2 < max_score)
UNION ALL SELECT user_id, id, 'deleted' FROM fx_stroop WHERE score * 2 < max_score
UNION ALL SELECT user_id, -id - 1, 'absent' FROM fx_stroop WHERE score * 2 < max_score""")
_check("delete_all_results", """
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'deleted' ELSE 'kept' END AS state, count(*) AS n
FROM fx_results GROUP BY user_id""")
_check("delete_session", """
SELECT user_id, id, CASE WHEN duration_minutes < 10 THEN 'deleted' ELSE 'kept' END AS state FROM fx_sessions""")
_check("delete_entries", """
SELECT user_id, date, tasks_completed, focus_minutes, 'kept' AS state FROM fx_daily WHERE tasks_completed <> 0
UNION ALL SELECT user_id, date, NULL, NULL, 'deleted' FROM fx_daily WHERE tasks_completed = 0""")

# --- streams and sessions ---------------------------------------------------------------

_check("stream_daily_activity", "SELECT * FROM fx_daily")
_check("stream_weekly_activity", """
SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(tasks_completed) AS BIGINT) AS tasks_completed,
       CAST(sum(focus_minutes) AS BIGINT) AS focus_minutes
FROM fx_daily GROUP BY user_id, CAST(date_trunc('week', date) AS DATE)""")
_check("stream_daily_windows", "SELECT * FROM fx_daily")
_check("stream_weekly_windows", """
SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(tasks_completed) AS BIGINT) AS tasks_completed,
       CAST(sum(focus_minutes) AS BIGINT) AS focus_minutes
FROM fx_daily GROUP BY user_id, CAST(date_trunc('week', date) AS DATE)""")
_check("sessions_on_days", """
SELECT user_id, id, task_id, duration_minutes, completed_at FROM fx_sessions
WHERE CAST(completed_at AS DATE) IN (SELECT date FROM fx_daily WHERE tasks_completed >= 3 AND day(date) % 7 = 1)""")
_check("stream_latest_profile", "SELECT * FROM fx_blended")
_check("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
_check("stream_sessions", "SELECT * FROM fx_timer_sessions")
_check("stream_sessions_settled", "SELECT * FROM fx_timer_sessions")
_check("reconstruct_sessions", "SELECT * FROM fx_timer_sessions")
_CHAINS = """
SELECT user_id, chain, min(started_at) AS started_at, max(ended_at) AS ended_at, count(*) AS sessions,
       count(*) FILTER (WHERE NOT is_break AND completed) AS focus_blocks,
       CAST(sum(logged_minutes) AS BIGINT) AS focus_minutes,
       arg_min(task_id, (started_at, start_event_id)) FILTER (WHERE NOT is_break AND task_id IS NOT NULL) AS task_id
FROM (SELECT *, CAST(sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY started_at, start_event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain
      FROM (SELECT *, coalesce(lag(completed) OVER w AND lag(is_break) OVER w <> is_break
                               AND epoch_us(started_at) - epoch_us(lag(ended_at) OVER w) <= 600000000, false) AS follows
            FROM fx_timer_sessions WINDOW w AS (PARTITION BY user_id ORDER BY started_at, start_event_id)) x) y
GROUP BY user_id, chain"""
_check("auto_cycle_chains", _CHAINS)
_check("stream_chains", _CHAINS.replace("SELECT user_id, chain,", "SELECT user_id, min(start_event_id) AS start_event_id,"))
