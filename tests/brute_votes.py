"""Brute force for the vote log: one pass over all events in time order."""

import re


def standing(labels, corrections):
    """{pair: (choice, number standing)} from lists of dicts."""
    votes, events, cases, n = {}, [], set(), {}
    for r in labels:
        if r["pair_id"] and r["corrected_from"] is not None:
            cases.add(r["pair_id"])
        if not r["pair_id"] or r["ts"] is None:
            continue
        k = (r["pair_id"], r["session_id"] or "", r["ts"])
        cf = r["corrected_from"]
        rank = (cf is not None, (cf or r["choice"]) is None, cf or r["choice"] or "")
        if k not in votes or rank < votes[k][0]:
            votes[k] = (rank, cf if cf is not None else r["choice"])
        if cf is not None and r["corrected_at"] is not None:
            events.append((r["corrected_at"], 1, r["pair_id"], r["ts"], r["choice"]))
    for k, v in votes.items():
        n[k[0]] = n.get(k[0], 0) + 1
        events.append((k[2], 0, k[0], k, v[1]))
    for r in corrections:
        o, rm = r["original"] or {}, r["removed"] or {}
        pair = r["pair_id"] or o.get("pair_id") or rm.get("pair_id")
        if pair:
            cases.add(pair)
        if not pair or r["ts"] is None:
            continue
        a = re.sub(r"\s+", "", (r["action"] or "").lower())
        new = r["to_choice"] if r["to_choice"] is not None else r["new_choice"]
        if a == "undo":
            events.append((r["ts"], 2, pair, rm.get("ts"), None))
        elif a == "" and new is not None:
            events.append((r["ts"], 1, pair, o.get("ts"), new))
    state = {}
    for t, kind, pair, target, value in sorted(set(events), key=lambda e: (e[0], e[1], e[2], str(e[3]), str(e[4]))):
        s = state.setdefault(pair, {})
        if kind == 0:
            s[(target[2], target[1])] = value
            continue
        hit = [k for k in s if k[0] == target] if target is not None else ([max(s)] if s else [])
        for k in hit:
            if kind == 1:
                s[k] = value
            else:
                del s[k]
    out = {p: (s[max(s)], len(s)) for p, s in state.items() if s}
    return out, {p: out[p][0] for p in out if p in cases or n[p] > 1}
