"""Derivation with bodies on each episode's last rule base, as statements: grounding, chaining and the kinds of ban.

Context ctx0 holds, ctx1 does not. The universe is the eight entities, so grounding multiplies by a constant.
"""

from normalog.plans.library import relation

relation("eps", "SELECT DISTINCT ep FROM ev")
relation("last_rules", "SELECT ep, rid, ent, neg, prio, body FROM timeline WHERE valid_to = 1000000 AND NOT retracted")
relation("unary_nodes", "SELECT s.ep, e.ent, e.ent % 3 AS grp FROM eps s JOIN ents e ON true")
relation("applicable", "SELECT * FROM last_rules WHERE body IN ('', 'ctx0')")
relation("applicable_tops", "SELECT ep, ent, max(CASE WHEN neg THEN prio END) AS top_neg, max(CASE WHEN NOT neg THEN prio END) AS top_pos FROM applicable GROUP BY ep, ent")
# a sign is derived if its top is not below the other sign's
relation("base_closure", "SELECT ep, ent, true AS neg FROM applicable_tops WHERE top_neg IS NOT NULL AND coalesce(top_neg >= top_pos, true) UNION ALL SELECT ep, ent, false FROM applicable_tops WHERE top_pos IS NOT NULL AND coalesce(top_pos >= top_neg, true)")
# an even entity is an alias of the next
relation("alias_round", "SELECT ep, ent, neg FROM base_closure UNION SELECT ep, ent - 1, neg FROM base_closure WHERE ent % 2 = 1")
# an allowed entity allows the one two above it; four rounds reach all eight
relation("chain_1", "SELECT ep, ent FROM base_closure WHERE NOT neg AND ent < 2")
relation("chain_2", "SELECT ep, ent FROM chain_1 UNION SELECT ep, ent + 2 FROM chain_1")
relation("chain_3", "SELECT ep, ent FROM chain_2 UNION SELECT ep, ent + 2 FROM chain_2 WHERE ent < 6")
relation("chain_4", "SELECT ep, ent FROM chain_3 UNION SELECT ep, ent + 2 FROM chain_3 WHERE ent < 6")
relation("group_bans", "SELECT ep, ent AS grp, max(prio) AS prio FROM last_rules WHERE neg AND ent < 3 GROUP BY ep, ent")
relation("held_contexts", "SELECT DISTINCT ep, cond FROM rule_events WHERE cond <> '' AND kind = 'CONDITION'")
relation("roster", "SELECT ep, ent, max_by(kind = 'ADD', ord) AS certified FROM raw_rules WHERE kind IN ('ADD', 'RETRACT') GROUP BY ep, ent")
relation("limits", "SELECT ep, sess AS valid_from, coalesce(lead(sess) OVER (PARTITION BY ep ORDER BY sess), 1000000) AS valid_to, cap FROM (SELECT ep, sess, max_by(k, ord) AS cap FROM raw_rules WHERE motif = 0 AND kind = 'SUPPORT' GROUP BY ep, sess) x")

QUERIES = {
    "ground_unary": "SELECT ep, concat('~allow(e', ent, ')') AS head, concat('grp(e', ent, ',g', grp, ')') AS body FROM unary_nodes",
    "ground_pair": "SELECT a.ep, concat('~allow(e', b.ent, ')') AS head, concat('allow(e', a.ent, '),pair(e', a.ent, ',e', b.ent, ')') AS body FROM unary_nodes a JOIN unary_nodes b ON b.ep = a.ep",
    "forward_chain_bounded": "SELECT ep, ent FROM chain_4",
    "closure_literals": "SELECT ep, concat(CASE WHEN neg THEN '~' ELSE '' END, 'allow(e', ent, ')') AS literal FROM alias_round UNION SELECT ep, 'task_feasible' FROM alias_round WHERE NOT neg",
    "alias_inheritance": "SELECT a.ep, a.ent, a.neg FROM alias_round a WHERE NOT EXISTS (SELECT 1 FROM base_closure b WHERE b.ep = a.ep AND b.ent = a.ent AND b.neg = a.neg)",
    "group_ban": "SELECT u.ep, u.ent, g.prio AS ban_prio, t.top_pos IS NULL OR g.prio >= t.top_pos AS banned FROM unary_nodes u JOIN group_bans g ON g.ep = u.ep AND g.grp = u.grp LEFT JOIN applicable_tops t ON t.ep = u.ep AND t.ent = u.ent",
    "conjunctive_ban": "SELECT r.ep, r.ent, count(DISTINCT h.cond) = 2 AS banned FROM (SELECT DISTINCT ep, ent FROM last_rules WHERE neg) r LEFT JOIN held_contexts h ON h.ep = r.ep GROUP BY r.ep, r.ent",
    "certification_ban": "SELECT u.ep, u.ent, NOT coalesce(c.certified, u.ent % 2 = 0) AS banned FROM unary_nodes u LEFT JOIN roster c ON c.ep = u.ep AND c.ent = u.ent",
    "threshold_ban": "SELECT p.ep, p.probe, l.cap, coalesce(p.k > l.cap, false) AS banned FROM probes p LEFT JOIN limits l ON l.ep = p.ep AND l.valid_from <= p.sess AND p.sess < l.valid_to",
}
