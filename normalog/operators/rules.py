"""The rule store and the derivation over it, as window folds, as-of joins and closed forms.

Rule events come from ``events``: a user is an episode, twelve logical sessions a day. Fields of a rule fold
separately: what resets each is a running count, and the state is the first value since the last reset.
"""

from normalog.plans.library import relation

relation("ev", "SELECT user_id AS ep, 12 * day(ts) AS sess, event_id, event_type, {json_k} AS k, row_number() OVER (PARTITION BY user_id ORDER BY day(ts), ts, event_id) AS ord FROM events")
relation("raw_rules", """
SELECT ep, sess, ord, event_id, k, k % 8 AS ent, event_id % 4 AS rank, k % 3 AS motif,
  CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'view' THEN 'CONFLICT' WHEN 'error' THEN 'SUPERSEDE' WHEN 'purchase' THEN 'SUPPORT'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'CONDITION' ELSE 'RETRACT' END END AS kind,
  concat('r', k % 8, CASE WHEN event_type = 'view' THEN 'b' WHEN event_type = 'signup' OR event_id % 2 = 0 THEN 'a' ELSE 'b' END) AS rid,
  CASE event_type WHEN 'view' THEN true WHEN 'error' THEN k % 3 = 0 ELSE false END AS neg,
  100000 * (event_id % 4) + event_id AS prio, CASE WHEN event_type = 'purchase' THEN 50000 ELSE 0 END AS delta,
  CASE WHEN k % 3 = 0 THEN '' ELSE concat('ctx', k % 2) END AS cond FROM ev""")
# an update of a rule that was never added is dropped
relation("rule_events", "SELECT * FROM (SELECT *, sum(CASE WHEN kind IN ('ADD', 'CONFLICT') THEN 1 ELSE 0 END) OVER (PARTITION BY ep, rid ORDER BY ord) AS n_fresh FROM raw_rules) x WHERE n_fresh > 0")
relation("segments", """
SELECT *, sum(CASE WHEN kind IN ('ADD', 'CONFLICT', 'SUPERSEDE') THEN 1 ELSE 0 END) OVER (PARTITION BY ep, rid ORDER BY ord) AS n_reset,
  sum(CASE WHEN kind IN ('ADD', 'CONFLICT', 'SUPERSEDE', 'CONDITION') THEN 1 ELSE 0 END) OVER (PARTITION BY ep, rid ORDER BY ord) AS n_body FROM rule_events""")
relation("rule_states", """
SELECT ep, rid, ord, sess, ent, event_id AS origin, first_value(neg) OVER r AS neg, first_value(sess) OVER f AS session,
  first_value(prio) OVER r + sum(delta) OVER r AS prio, first_value(CASE WHEN kind = 'CONDITION' THEN cond ELSE '' END) OVER b AS body,
  max(CASE WHEN kind = 'RETRACT' THEN 1 ELSE 0 END) OVER r = 1 AS retracted FROM segments
WINDOW r AS (PARTITION BY ep, rid, n_reset ORDER BY ord), f AS (PARTITION BY ep, rid, n_fresh ORDER BY ord), b AS (PARTITION BY ep, rid, n_body ORDER BY ord)""")
relation("session_states", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ep, rid, sess ORDER BY ord DESC) AS last_first FROM rule_states) x WHERE last_first = 1")
relation("timeline", "SELECT ep, rid, ent, neg, prio, body, retracted, session, origin, sess AS valid_from, coalesce(lead(sess) OVER (PARTITION BY ep, rid ORDER BY sess), 1000000) AS valid_to FROM session_states")
relation("sessions_of", "SELECT DISTINCT ep, sess FROM rule_events")
relation("ents", "SELECT {rows|{series|0|7}} AS ent")
# Slice without bodies: every live rule's node applies.
relation("nodes_at", "SELECT s.ep, s.sess, t.rid, t.ent, t.neg, t.prio FROM sessions_of s JOIN timeline t ON t.ep = s.ep AND t.valid_from <= s.sess AND s.sess < t.valid_to WHERE NOT t.retracted")
relation("tops", "SELECT ep, sess, ent, max(CASE WHEN NOT neg THEN prio END) AS top_pos, max(CASE WHEN neg THEN prio END) AS top_neg FROM nodes_at GROUP BY ep, sess, ent")
# The grounded extension in closed form: the top class of an atom is in, and so is all above the other side's top.
relation("extension", """
SELECT n.*, CASE WHEN neg THEN top_pos ELSE top_neg END AS other, CASE WHEN neg THEN top_neg ELSE top_pos END AS own,
  coalesce(CASE WHEN neg THEN top_neg ELSE top_pos END > CASE WHEN neg THEN top_pos ELSE top_neg END, true)
  OR (coalesce(top_pos = top_neg, false) AND prio = CASE WHEN neg THEN top_neg ELSE top_pos END) AS is_in
FROM nodes_at n JOIN tops USING (ep, sess, ent)""")
# A status can change only where one of the entity's own rules does, or at the episode's first session.
relation("points", "SELECT DISTINCT ep, ent, sess FROM (SELECT ep, ent, valid_from AS sess FROM timeline UNION ALL SELECT f.ep, e.ent, f.sess FROM (SELECT ep, min(sess) AS sess FROM rule_events GROUP BY ep) f JOIN ents e ON true) x")
relation("point_tops", """
SELECT p.ep, p.ent, p.sess, max(CASE WHEN NOT t.neg THEN t.prio END) AS top_pos, max(CASE WHEN t.neg THEN t.prio END) AS top_neg
FROM points p LEFT JOIN timeline t ON t.ep = p.ep AND t.ent = p.ent AND t.valid_from <= p.sess AND p.sess < t.valid_to AND NOT t.retracted GROUP BY p.ep, p.ent, p.sess""")
relation("status_points", "SELECT ep, ent, sess, CASE WHEN top_neg IS NOT NULL AND coalesce(top_neg >= top_pos, true) THEN 'forbidden' WHEN top_pos IS NOT NULL THEN 'licensed' ELSE 'silent' END AS status FROM point_tops")
relation("status_spans", "SELECT ep, ent, status, sess AS valid_from, coalesce(lead(sess) OVER (PARTITION BY ep, ent ORDER BY sess), 1000000) AS valid_to FROM status_points")
relation("status_at", "SELECT s.ep, s.sess, p.ent, p.status FROM sessions_of s JOIN status_spans p ON p.ep = s.ep AND p.valid_from <= s.sess AND s.sess < p.valid_to")
relation("changes", "SELECT ep, ent, sess, status FROM (SELECT *, lag(status) OVER (PARTITION BY ep, ent ORDER BY sess) AS before FROM status_points) x WHERE status IS DISTINCT FROM before")
relation("probes", "SELECT ep, sess, ord, event_id AS probe, k % 8 AS option_key, k % 3 AS motif, event_type, event_id % 5 AS pick, k FROM ev WHERE event_id % 7 = 0")
relation("options", "SELECT p.ep, p.sess, p.probe, (option_key + o.d) % 8 AS ent, o.i FROM probes p JOIN (SELECT 0 AS i, 0 AS d UNION ALL SELECT 1, 1 UNION ALL SELECT 2, 3 UNION ALL SELECT 3, 6) o ON true")
relation("judged", "SELECT o.*, coalesce(s.status, 'silent') AS status FROM options o LEFT JOIN status_spans s ON s.ep = o.ep AND s.ent = o.ent AND s.valid_from <= o.sess AND o.sess < s.valid_to")
relation("label_sets", "SELECT ep, probe, {set|CASE WHEN status <> 'forbidden' THEN ent END} AS compliant, {set|CASE WHEN status = 'licensed' THEN ent END} AS licensed, {set|CASE WHEN status = 'forbidden' THEN ent END} AS violating, count(CASE WHEN status = 'forbidden' THEN 1 END) AS n_violating, count(CASE WHEN status = 'licensed' THEN 1 END) AS n_licensed FROM judged GROUP BY ep, probe")
relation("labelled", "SELECT p.*, l.compliant, l.licensed, l.violating, l.n_violating, l.n_licensed, lag(l.compliant) OVER w AS prev_compliant, lag(p.probe) OVER w AS prev_probe FROM probes p JOIN label_sets l USING (ep, probe) WINDOW w AS (PARTITION BY ep, option_key ORDER BY ord)")
relation("trap_options", "SELECT l.ep, l.probe, c.ent FROM labelled l JOIN judged b ON b.ep = l.ep AND b.probe = l.prev_probe AND b.status <> 'forbidden' JOIN judged c ON c.ep = l.ep AND c.probe = l.probe AND c.ent = b.ent AND c.status = 'forbidden'")
relation("traps", "SELECT ep, probe, {set|ent} AS stale_trap FROM trap_options GROUP BY ep, probe")
relation("spans", "SELECT o.ep, o.probe, max(o.sess - c.last) AS recall_span, sum(greatest(c.n - 1, 0)) AS n_flips FROM options o JOIN (SELECT o.ep, o.probe, o.ent, max(c.sess) AS last, count(*) AS n FROM options o JOIN changes c ON c.ep = o.ep AND c.ent = o.ent AND c.sess <= o.sess GROUP BY o.ep, o.probe, o.ent) c USING (ep, probe, ent) GROUP BY o.ep, o.probe")
relation("features", """
SELECT l.ep, l.probe, l.sess, l.ord, l.motif, l.event_type, l.option_key, l.pick, l.licensed, l.violating, l.compliant, l.n_violating, l.n_licensed,
  coalesce(s.recall_span, 0) AS recall_span, coalesce(s.n_flips, 0) AS n_flips, coalesce(t.stale_trap, '') AS stale_trap, t.probe IS NOT NULL AS is_trap,
  coalesce(l.prev_compliant <> l.compliant, false) AS flip
FROM labelled l LEFT JOIN spans s USING (ep, probe) LEFT JOIN traps t USING (ep, probe)""")
relation("weighted", """
SELECT *, round(greatest(3e-1, 1 + CASE WHEN recall_span > 200 THEN 1 ELSE 0 END + CASE WHEN is_trap THEN 8e-1 ELSE 0e0 END + 4e-1 * greatest(n_violating - 1, 0) - 3e-1 * greatest(n_licensed - 1, 0)), 3) AS weight,
  CASE WHEN recall_span <= 96 THEN 'near' WHEN recall_span <= 200 THEN 'mid' ELSE 'far' END AS span_tier FROM features""")
relation("graded", """
SELECT w.*, j.ent AS chosen, coalesce(j.status = 'forbidden', false) AS violation, coalesce(j.status = 'licensed', false) AS completed, j.ent IS NULL AS abstained,
  CASE WHEN j.status = 'forbidden' THEN -1 WHEN j.status = 'licensed' THEN 1 ELSE 0 END AS score, x.ent IS NOT NULL AS took_stale_trap
FROM weighted w LEFT JOIN judged j ON j.ep = w.ep AND j.probe = w.probe AND j.i = w.pick LEFT JOIN trap_options x ON x.ep = w.ep AND x.probe = w.probe AND x.ent = j.ent""")

QUERIES = {
    "rule_events_derived": "SELECT ep, sess, ord, event_id, kind, rid, neg, prio, delta, cond FROM rule_events",
    "fold_current_rules": "SELECT ep, rid, neg, prio, body, retracted, session, origin FROM (SELECT *, row_number() OVER (PARTITION BY ep, rid ORDER BY ord DESC) AS n FROM rule_states) x WHERE n = 1",
    "extension_closed_form": "SELECT ep, sess, rid, ent, neg, prio, is_in FROM extension",
    "entity_status_asof": "SELECT ep, sess, ent, status FROM status_at",
    "probe_labels": "SELECT ep, probe, compliant, licensed, violating FROM labelled",
    "graded_trace": "SELECT ep, probe, chosen, violation, completed, abstained, score, took_stale_trap FROM graded",
    "exam_score": "SELECT count(*) AS n_probes, round(sum(weight * score), 3) AS points, round(sum(weight), 3) AS max_points, round(sum(weight * score) / sum(weight), 6) AS score, round(avg(score), 6) AS score_unweighted FROM graded",
    "exam_by_span_tier": "SELECT span_tier, count(*) AS n, round(sum(weight * score) / sum(weight), 6) AS score FROM graded GROUP BY span_tier",
    "replay_asof": "SELECT ep, rid, neg, prio, body, retracted FROM timeline WHERE valid_from <= 180 AND 180 < valid_to",
    "timeline_scd2": "SELECT ep, rid, valid_from, valid_to, neg, prio, body, retracted FROM timeline",
    "retracted_instances": "SELECT ep, rid, count(*) AS n FROM rule_states WHERE retracted GROUP BY ep, rid",
    "support_priority_sum": "SELECT ep, rid, sum(delta) AS support, count(CASE WHEN kind = 'SUPPORT' THEN 1 END) AS n_support FROM rule_events GROUP BY ep, rid",
    "speaker_rank_asof": "SELECT p.ep, p.probe, max_by(r.rank, r.ord) AS rank FROM probes p JOIN raw_rules r ON r.ep = p.ep AND r.ent = p.option_key AND r.sess <= p.sess GROUP BY p.ep, p.probe",
    "threshold_asof": "SELECT p.ep, p.probe, max_by(r.k, r.ord) AS threshold, coalesce(p.k > max_by(r.k, r.ord), false) AS above FROM probes p LEFT JOIN raw_rules r ON r.ep = p.ep AND r.motif = 0 AND r.kind = 'SUPPORT' AND r.sess <= p.sess GROUP BY p.ep, p.probe, p.k",
    "roster_asof": "SELECT p.ep, p.probe, e.ent, coalesce(max_by(r.kind = 'ADD', r.ord), e.ent % 2 = 0) AS certified FROM probes p JOIN ents e ON true LEFT JOIN raw_rules r ON r.ep = p.ep AND r.ent = e.ent AND r.kind IN ('ADD', 'RETRACT') AND r.sess <= p.sess GROUP BY p.ep, p.probe, e.ent",
    "uncertified_anti": "SELECT s.ep, e.ent FROM (SELECT DISTINCT ep FROM ev) s JOIN ents e ON true WHERE NOT EXISTS (SELECT 1 FROM rule_events r WHERE r.ep = s.ep AND r.ent = e.ent AND r.kind = 'ADD')",
    "status_change_points": "SELECT ep, ent, sess, status FROM changes",
    "stale_trap": "SELECT ep, probe, stale_trap FROM traps",
    "flip": "SELECT ep, probe, flip FROM features",
    "recall_span": "SELECT ep, probe, recall_span FROM features",
    "n_flips": "SELECT ep, probe, n_flips FROM features",
    "difficulty_weight": "SELECT ep, probe, weight FROM weighted",
    "span_tier": "SELECT span_tier, count(*) AS n FROM weighted GROUP BY span_tier",
    "crutch_probes": """SELECT j.ep, j.probe FROM judged j LEFT JOIN (SELECT ep, ent, min(CASE WHEN status = 'licensed' THEN sess END) AS first_licensed, min(CASE WHEN status = 'forbidden' THEN sess END) AS first_forbidden FROM status_at GROUP BY ep, ent) h ON h.ep = j.ep AND h.ent = j.ent
WHERE j.status = 'licensed' GROUP BY j.ep, j.probe HAVING {every|coalesce(h.first_forbidden >= j.sess, true) AND j.sess - coalesce(h.first_licensed, j.sess) > 100}""",
    "select_traps": "SELECT ep, probe, sess, place FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY t DESC, probe) AS place FROM (SELECT ep, probe, sess, CASE WHEN is_trap THEN 1 ELSE 0 END AS t, row_number() OVER (PARTITION BY ep, sess ORDER BY CASE WHEN is_trap THEN 0 ELSE 1 END, probe) AS n FROM features) x WHERE n = 1) y WHERE place <= 3",
    "select_far": "SELECT ep, probe, sess, place FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY recall_span DESC, probe) AS place FROM (SELECT ep, probe, sess, recall_span, row_number() OVER (PARTITION BY ep, sess ORDER BY recall_span DESC, probe) AS n FROM features) x WHERE n = 1) y WHERE place <= 3",
    "select_event_kind": "SELECT ep, probe, sess FROM (SELECT *, row_number() OVER (PARTITION BY ep, sess ORDER BY probe) AS n FROM features WHERE event_type = 'error') x WHERE n = 1",
    "select_ids": "SELECT ep, probe, sess FROM features WHERE probe IN (7, 70, 700)",
    "renumber_probes": "SELECT ep, probe, concat(ep, '#p', row_number() OVER (PARTITION BY ep ORDER BY ord) - 1) AS new_id FROM probes",
    "kind_counts_pivot": "SELECT ep, count(CASE WHEN kind = 'ADD' THEN 1 END) AS n_add, count(CASE WHEN kind = 'CONFLICT' THEN 1 END) AS n_conflict, count(CASE WHEN kind = 'SUPERSEDE' THEN 1 END) AS n_supersede, count(CASE WHEN kind = 'SUPPORT' THEN 1 END) AS n_support, count(CASE WHEN kind = 'CONDITION' THEN 1 END) AS n_condition, count(CASE WHEN kind = 'RETRACT' THEN 1 END) AS n_retract FROM rule_events GROUP BY ep",
    "verify_option_sets": "SELECT ep, probe, 'no compliant option' AS failure FROM labelled WHERE compliant = '' UNION ALL SELECT ep, probe, 'no licensed option' FROM labelled WHERE licensed = ''",
    "verify_overdeletion": "SELECT s.ep, s.sess, bool_or(s.status = 'licensed') AS feasible FROM status_at s GROUP BY s.ep, s.sess",
    "verify_traps_exist": "SELECT e.ep, count(t.probe) AS n_traps FROM (SELECT DISTINCT ep FROM probes) e LEFT JOIN traps t ON t.ep = e.ep GROUP BY e.ep",
    "verify_disjoint": "SELECT a.ep, a.probe, count(*) AS both FROM judged a JOIN judged b USING (ep, probe, ent) WHERE a.status = 'forbidden' AND b.status <> 'forbidden' GROUP BY a.ep, a.probe",
    "verify_self_contained": "SELECT j.ep, j.probe, j.ent FROM judged j WHERE j.status = 'forbidden' AND NOT EXISTS (SELECT 1 FROM raw_rules r WHERE r.ep = j.ep AND r.ent = j.ent AND r.sess <= j.sess)",
    "verify_priority_readable": "SELECT w.ep, w.sess, w.rid AS winner, l.rid AS loser, a.origin > b.origin AS newer FROM nodes_at w JOIN nodes_at l ON l.ep = w.ep AND l.sess = w.sess AND l.ent = w.ent AND l.neg <> w.neg AND w.prio > l.prio JOIN timeline a ON a.ep = w.ep AND a.rid = w.rid AND a.valid_from <= w.sess AND w.sess < a.valid_to JOIN timeline b ON b.ep = l.ep AND b.rid = l.rid AND b.valid_from <= l.sess AND l.sess < b.valid_to",
    "defeat_edges": "SELECT w.ep, w.sess, w.rid AS winner, l.rid AS loser FROM nodes_at w JOIN nodes_at l ON l.ep = w.ep AND l.sess = w.sess AND l.ent = w.ent AND l.neg <> w.neg AND w.prio > l.prio",
    "grounded_in": "SELECT ep, sess, rid FROM extension WHERE is_in",
    "grounded_out": "SELECT ep, sess, rid FROM extension WHERE NOT is_in",
    "contradictions": "SELECT ep, sess, ent FROM extension WHERE is_in GROUP BY ep, sess, ent HAVING count(DISTINCT neg) = 2",
    "rules_supporting": "SELECT ep, sess, ent, neg, {set|rid} AS rids FROM extension WHERE is_in GROUP BY ep, sess, ent, neg",
    "blamed_rules": "SELECT g.ep, g.probe, {set|x.rid} AS rids FROM graded g JOIN status_spans p ON p.ep = g.ep AND p.ent = g.chosen AND p.valid_from <= g.sess AND g.sess < p.valid_to JOIN extension x ON x.ep = g.ep AND x.ent = g.chosen AND x.sess = p.valid_from AND x.is_in WHERE g.violation GROUP BY g.ep, g.probe",
    "task_feasible": "SELECT ep, sess, count(DISTINCT ent) AS n_allowed FROM extension WHERE is_in AND NOT neg GROUP BY ep, sess",
    "stale_support": "SELECT g.ep, g.probe, {set|x.rid} AS rids FROM graded g JOIN extension x ON x.ep = g.ep AND x.ent = g.chosen AND NOT x.is_in AND NOT x.neg AND x.sess = g.sess GROUP BY g.ep, g.probe",
    "off_option": "SELECT g.ep, g.probe, g.option_key FROM graded g WHERE NOT EXISTS (SELECT 1 FROM options o WHERE o.ep = g.ep AND o.probe = g.probe AND o.ent = (g.pick + g.option_key) % 8)",
    "episode_rollup": "SELECT ep, {every|NOT violation} AS violation_free, {every|completed} AS all_completed, {every|NOT violation AND completed} AS compliant_success FROM graded GROUP BY ep",
    "violation_rate_by_event": "SELECT event_type, count(*) AS n, round(avg(CASE WHEN violation THEN 1e0 ELSE 0e0 END), 6) AS rate FROM graded GROUP BY event_type",
    "trap_vs_nontrap": "SELECT is_trap, count(*) AS n, round(avg(CASE WHEN violation THEN 1e0 ELSE 0e0 END), 6) AS rate FROM graded GROUP BY is_trap",
    "weighted_rates": "SELECT round(sum(CASE WHEN violation THEN weight ELSE 0 END) / sum(weight), 6) AS violation, round(sum(CASE WHEN completed THEN weight ELSE 0 END) / sum(weight), 6) AS completion, round(avg(weight), 6) AS mean_weight FROM graded",
    "abstention_two_ways": "SELECT count(CASE WHEN abstained THEN 1 END) AS no_act, count(CASE WHEN NOT violation AND NOT completed THEN 1 END) AS no_effect FROM graded",
    "stale_trap_rate": "SELECT count(*) AS n, round(avg(CASE WHEN took_stale_trap THEN 1e0 ELSE 0e0 END), 6) AS rate FROM graded WHERE is_trap",
    "canary_rates": "SELECT count(*) AS n, round(avg(CASE WHEN completed THEN 1e0 ELSE 0e0 END), 6) AS completion, round(avg(CASE WHEN violation THEN 1e0 ELSE 0e0 END), 6) AS false_violation FROM graded WHERE n_violating = 0",
    "summary_one_row": """SELECT count(DISTINCT ep) AS n_episodes, count(*) AS n_probes, round(sum(weight * score) / sum(weight), 6) AS exam, round(avg(CASE WHEN violation THEN 1e0 ELSE 0e0 END), 6) AS violation,
  round(avg(CASE WHEN completed THEN 1e0 ELSE 0e0 END), 6) AS completion, round(avg(CASE WHEN abstained THEN 1e0 ELSE 0e0 END), 6) AS abstention, round(avg(CASE WHEN is_trap THEN CASE WHEN violation THEN 1e0 ELSE 0e0 END END), 6) AS trap,
  round(avg(CASE WHEN NOT is_trap THEN CASE WHEN violation THEN 1e0 ELSE 0e0 END END), 6) AS non_trap, round(avg(weight), 6) AS mean_weight FROM graded""",
    "adaptation_lag": """SELECT ep, motif, first_flip, (SELECT min(n) FROM (SELECT ep, motif, violation, row_number() OVER (PARTITION BY ep, motif ORDER BY ord) AS n FROM graded) y WHERE y.ep = x.ep AND y.motif = x.motif AND y.n >= x.first_flip AND NOT y.violation) - first_flip AS lag
FROM (SELECT ep, motif, min(CASE WHEN flip THEN n END) AS first_flip FROM (SELECT *, row_number() OVER (PARTITION BY ep, motif ORDER BY ord) AS n FROM graded) z GROUP BY ep, motif) x WHERE first_flip IS NOT NULL""",
    "interference_split": """SELECT disturbed, count(*) AS n, round(avg(CASE WHEN violation THEN 1e0 ELSE 0e0 END), 6) AS rate FROM (
  SELECT g.*, EXISTS (SELECT 1 FROM rule_events r WHERE r.ep = g.ep AND r.motif <> g.motif AND r.sess > g.prev_sess AND r.sess <= g.sess) AS disturbed
  FROM (SELECT *, lag(sess, 1, 0) OVER w AS prev_sess, lag(flip, 1, true) OVER w AS prev_flip FROM graded WINDOW w AS (PARTITION BY ep, motif ORDER BY ord)) g WHERE NOT flip AND NOT prev_flip) x GROUP BY disturbed""",
    "condition_report_grouping_sets": "SELECT motif, event_type, span_tier, grouping(event_type) AS all_events, grouping(span_tier) AS all_tiers, count(*) AS n, count(CASE WHEN violation THEN 1 END) AS viol, count(CASE WHEN completed THEN 1 END) AS done, count(CASE WHEN NOT violation AND NOT completed THEN 1 END) AS abst FROM graded GROUP BY GROUPING SETS ((motif, event_type, span_tier), (motif, event_type), (motif))",
    "confusion_matrix": "SELECT j.status AS truth, CASE WHEN j.ent % 3 = 0 THEN 'forbidden' WHEN j.ent % 3 = 1 THEN 'licensed' ELSE 'silent' END AS verdict, count(*) AS n FROM judged j GROUP BY 1, 2",
    "verdict_agreement": "SELECT count(*) AS n, count(CASE WHEN j.status = (CASE WHEN j.ent % 3 = 0 THEN 'forbidden' WHEN j.ent % 3 = 1 THEN 'licensed' ELSE 'silent' END) THEN 1 END) AS agree FROM judged j",
    "disagreement_taxonomy": """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM rule_events r WHERE r.ep = j.ep AND r.ent = j.ent AND r.sess > j.sess - 24 AND r.sess <= j.sess) THEN 'in_window'
  WHEN NOT EXISTS (SELECT 1 FROM rule_events r WHERE r.ep = j.ep AND r.ent = j.ent AND r.sess <= j.sess AND r.rank > 0) THEN 'perception' ELSE 'tracking' END AS reason FROM judged j WHERE j.status = 'forbidden') x GROUP BY reason""",
    "compliance_crosstab": "SELECT j.status AS label, count(CASE WHEN g.violation THEN 1 END) AS viol, count(CASE WHEN g.completed AND NOT g.violation THEN 1 END) AS done, count(CASE WHEN NOT g.completed AND NOT g.violation THEN 1 END) AS abst FROM graded g JOIN judged j ON j.ep = g.ep AND j.probe = g.probe AND j.i = 0 GROUP BY j.status",
    "extraction_recall": "SELECT r.kind, count(*) AS n, count(m.event_id) AS matched FROM rule_events r LEFT JOIN (SELECT DISTINCT event_id FROM raw_rules WHERE rank > 0) m ON m.event_id = r.event_id GROUP BY r.kind",
    "extraction_precision": "SELECT count(*) AS statements, count(r.event_id) AS matched FROM raw_rules s LEFT JOIN rule_events r ON r.event_id = s.event_id",
    "guarded_upsert": "SELECT ep, ent, ord, rank, coalesce(rank >= max(rank) OVER (PARTITION BY ep, ent ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM raw_rules",
    "dead_letter_counts": "SELECT CASE WHEN n.n_fresh IS NULL OR n.n_fresh = 0 THEN 'dangling_ref' WHEN n.rank = 0 THEN 'rank0' ELSE 'applied' END AS reason, count(*) AS n FROM (SELECT *, sum(CASE WHEN kind IN ('ADD', 'CONFLICT') THEN 1 ELSE 0 END) OVER (PARTITION BY ep, rid ORDER BY ord) AS n_fresh FROM raw_rules) n GROUP BY 1",
    "rtm_priority": "SELECT ep, ord, CASE kind WHEN 'SUPPORT' THEN 10000000 + ord WHEN 'RETRACT' THEN ord ELSE 1000000 * rank + ord END AS priority FROM raw_rules",
    "rtm_target": "SELECT ep, sess, ent, max_by(rid, prio) AS target FROM nodes_at WHERE neg AND {div|prio|100000} <= 2 GROUP BY ep, sess, ent",
    "rtm_referential": "SELECT ep, sess, ent, max(rid) AS rid FROM rule_events WHERE neg GROUP BY ep, sess, ent HAVING count(*) = 1",
    "last_k_per_entity": "SELECT ep, ent, ord, kind FROM (SELECT *, row_number() OVER (PARTITION BY ep, ent ORDER BY ord DESC) AS n FROM rule_events) x WHERE n <= 4",
    "last_wins_trace": "SELECT ep, option_key, max_by(pick, ord) AS pick FROM probes GROUP BY ep, option_key",
    "part_supersession": "SELECT a.ep, a.probe FROM probes a WHERE a.pick <> 4 AND NOT EXISTS (SELECT 1 FROM probes f WHERE f.ep = a.ep AND f.pick = 4 AND f.option_key = a.option_key)",
    "resume_range_anti": "SELECT DISTINCT p.ep, p.sess FROM probes p WHERE NOT EXISTS (SELECT 1 FROM probes d WHERE d.ep = p.ep AND d.pick = 0 AND d.sess >= p.sess AND d.sess < p.sess + 20)",
    "trace_key_pushdown": "SELECT e.ep, count(*) AS n FROM ev e WHERE e.ep IN (SELECT ep FROM probes WHERE pick = 4) GROUP BY e.ep",
    "harness_failure_filter": "SELECT ep, probe FROM graded WHERE NOT (abstained AND event_type IN ('error', 'click'))",
    "release_summary_band": "SELECT {div|ep|50} AS band, count(DISTINCT ep) AS n, min(weight) AS min_weight, max(weight) AS max_weight, round(avg(weight), 6) AS mean_weight, sum(CASE WHEN is_trap THEN 1 ELSE 0 END) AS traps FROM weighted GROUP BY 1",
    "release_summary_world": "SELECT ep % 6 AS world, count(DISTINCT ep) AS n, count(*) AS probes, round(avg(CASE WHEN span_tier = 'far' THEN 1e0 ELSE 0e0 END), 6) AS far FROM weighted GROUP BY 1",
    "blind_projection": "SELECT ep, probe, sess, option_key FROM labelled",
    "load_steps_nested": "SELECT p.ep, p.probe, j.ent FROM probes p LEFT JOIN options j ON j.ep = p.ep AND j.probe = p.probe AND j.i = p.pick",
    "load_steps_flat": "SELECT o.ep, o.probe, count(*) AS n_calls FROM options o JOIN probes p ON p.ep = o.ep AND p.probe = o.probe AND o.i <= p.pick GROUP BY o.ep, o.probe",
}
