"""A sound corpus passes; each damage is found, and nothing else."""

from __future__ import annotations

import copy
import json

from normalog.sources import corpus


def sound() -> dict:
    out: dict = {"nl": {}, "hnl": {}, "terse": {}, "noise": {}, "numeric": {}, "cert": {}, "derived": {}, "surface": {}, "pad": {}}
    for line in corpus.TEMPLATES.strip().split("\n"):
        left, req = line.split("|")[:2]
        place, least, *_ = left.split()
        path, key = place.split(".")
        texts = [f"text {i} of {key.lower()} " + " ".join(f"{{{r}}}" for r in req.split()) + ("\na\nb" if key == "blocks" else "") for i in range(int(least))]
        home = out[path] if path else out
        home[key] = texts[0] if key == "conj" or path in ("cert", "derived") else texts
    out["cert"]["rule"] = "a violation otherwise"
    words = [a + b + c for a in "bdfghjklmn" for b in "aeiou" for c in "rst"]
    out |= {"key": "k", "title": "t", "setting": "s", "sort": "room", "allow": "allow", "goal": "goal", "persona": "p", "hierarchy": None}
    out["entities"] = {"prefix": "rm", "names": [f"q{w}q" for w in words[:96]], "conditions": list("abcdef"), "groups": list("abcdef")}
    out["tools"] = {"read": [{"name": "n", "param": "p", "doc": "d"}] * 2, "act": {"name": "n", "param": "room", "doc": "d"}}
    out["people"] = {"roles": {"1": "a", "2": "b", "3": "c"}, "start": {f"P{i}": r for i, r in enumerate([3, 3, 2, 1, 1, 0, 0, 0, 0])}, "descr": {f"P{i}": "d" for i in range(5, 9)}, "authority_terms": ["the senate", "dean (acting)", "court"]}
    out["numeric"] |= {"ctx": "hot", "param": "t", "limit": "l", "unit": "", "dir": "above", "lo": 0, "hi": 10, "values": [2, 4, 6, 8]}
    out["surface"] |= {"layout": "flat", "sections": {k: [] for k in ("discussion", "decisions", "actions")}, "notice_frame": ["a", "b"], "you_prefix": "you"}
    out["pad"] |= {"first_names": [f"F{i}" for i in range(30)], "last_names": [f"L{i}" for i in range(20)], "slots": {f"slot_{c}": [f"v{i}" for i in range(8)] for c in "abcdef"}, "families": {f"fam{c}": [f"line {i} {{slot_a}} {{pct}}" for i in range(8)] for c in "abcde"}}
    return out


def test_damages(spark, tmp_path):
    damages = {
        "names": (lambda c: c["entities"]["names"].pop(), ("entities.names",)),
        "twice": (lambda c: c["entities"]["names"].__setitem__(5, c["entities"]["names"][4]), ("entities.names", "entities.names[4]", "entities.names[5]")),
        "slot": (lambda c: c["nl"]["ADD"].__setitem__(2, "no slot, {oops}"), ("nl.ADD[2]",)),
        "few": (lambda c: c["noise"]["praise"].pop(), ("noise.praise",)),
        "gone": (lambda c: c["hnl"].pop("LIFT"), ("hnl.LIFT",)),
        "entity": (lambda c: c["task_nl"].__setitem__(0, "go to " + c["entities"]["names"][9].upper()), ("task_nl[0]",)),
        "word": (lambda c: c["pad"]["side"].__setitem__(1, "it was Approved"), ("pad.side[1]",)),
        "claim": (lambda c: c["nl"]["CTX_ON"].__setitem__(0, "The Dean (acting) says {c}"), ("nl.CTX_ON[0]",)),
        "rank": (lambda c: c["people"]["start"].__setitem__("P0", 7), ("people.start.P0", "people.start")),
        "broken": (lambda c: c["pad"]["families"]["fama"].__setitem__(0, "open { brace"), ("pad.families.fama[0]",)),
        "value": (lambda c: c["numeric"]["values"].__setitem__(0, 12), ("numeric.values[0]",)),
        "tool": (lambda c: c["tools"]["act"].__setitem__("param", "x"), ("tools.act.param",)),
        "layout": (lambda c: c["surface"].__setitem__("layout", "sectioned"), tuple(f"surface.sections.{k}" for k in ("discussion", "decisions", "actions"))),
        "type": (lambda c: c.__setitem__("persona", 3), ("persona",)),
    }
    for name, (damage, _) in {**damages, "sound": (lambda c: None, ())}.items():
        c = copy.deepcopy(sound())
        damage(c)
        (tmp_path / f"{name}.json").write_text(json.dumps(c))
    got: dict = {}
    for r in corpus.failures(corpus.leaves(spark, str(tmp_path))).collect():
        got.setdefault(r.corpus.removesuffix(".json"), set()).add(r.place)
    assert got == {n: set(w) for n, (_, w) in damages.items()}
