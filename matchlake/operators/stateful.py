"""Order-dependent rules, as functions of one game's or one player's rows.

Each takes and gives a pandas frame and runs under applyInPandas: a group is one game (or one player of it), whose
number of rows does not grow with the number of games.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd


def lives(rows: pd.DataFrame, kills: pd.DataFrame | None = None, gap: float = 0.35, respawn: float = 12.0, tail: float = 3.0, near: float = 2.0, since: float = -np.inf, first: int = 0) -> pd.DataFrame:
    """Lives of one slot: game_id, slot, idx, t0, t1, ended ('death' or 'end').

    Runs of alive rows are split at gaps above `gap`. A run's end is a death where a kill of the slot is within `near`
    seconds (each kill confirms one end) or where nothing follows for `respawn` seconds; otherwise the life goes on. A
    run that starts less than `respawn` after a death is ignored. The last run ends in death only if rows go on for more
    than `tail` seconds after it. `since` is a death before these rows, `first` the number of the next life.
    """
    columns = ["game_id", "slot", "idx", "t0", "t1", "ended"]
    rows = rows.sort_values("t", kind="stable")
    alive = rows[rows["alive"]]
    if not len(alive):
        return pd.DataFrame({"game_id": pd.Series(dtype="int32"), "slot": pd.Series(dtype="int32"), "idx": pd.Series(dtype="int32"), "t0": pd.Series(dtype="float64"), "t1": pd.Series(dtype="float64"), "ended": pd.Series(dtype="object")})
    t = alive["t"].to_numpy()
    cuts = np.nonzero(np.diff(t) > gap)[0] + 1
    runs = [(part[0], part[-1]) for part in np.split(t, cuts)]
    times = sorted(kills["t"].tolist()) if kills is not None and len(kills) else []
    used: set[int] = set()

    def confirmed(end: float) -> bool:
        close = [(abs(k - end), i) for i, k in enumerate(times) if i not in used and abs(k - end) <= near]
        if close:
            used.add(min(close)[1])
        return bool(close)

    found: list[tuple[float, float, str]] = []
    start, died = None, since
    last_row = rows["t"].iat[-1]
    for i, (a, b) in enumerate(runs):
        if start is None:
            if a - died < respawn:
                continue
            start = a
        following = runs[i + 1][0] if i + 1 < len(runs) else None
        if confirmed(b) or (following is not None and following - b >= respawn) or (following is None and last_row - b > tail):
            found.append((start, b, "death"))
            start, died = None, b
        elif following is None:
            found.append((start, b, "end"))
    game, slot = rows["game_id"].iat[0], rows["slot"].iat[0]
    return pd.DataFrame([(game, slot, i, a, b, e) for i, (a, b, e) in enumerate(found, first)], columns=columns)


def anchored_waves(exits: pd.DataFrame, span: float = 8.0, least: int = 2) -> pd.DataFrame:
    """Groups of exits at most `span` after the first of the group, of `least` players or more; else the first is left out."""
    exits = exits.sort_values(["t", "slot"], kind="stable")
    t, slot = exits["t"].to_numpy(), exits["slot"].to_numpy()
    found, i = [], 0
    while i < len(t):
        j = int(np.searchsorted(t, t[i] + span, side="right"))
        players = len(set(slot[i:j].tolist()))
        if players >= least:
            found.append((len(found), t[i], t[j - 1], players))
            i = j
        else:
            i += 1
    out = pd.DataFrame(found, columns=["wave", "t0", "t1", "players"])
    return out.assign(game_id=exits["game_id"].iat[0], team=exits["team"].iat[0])[["game_id", "team", "wave", "t0", "t1", "players"]]


def lanes(spans: pd.DataFrame) -> pd.DataFrame:
    """The first lane that is free when each span starts; spans by start, then end."""
    spans = spans.sort_values(["t0", "t1", "event_id"], kind="stable")
    ends: list[float] = []
    lane = []
    for a, b in zip(spans["t0"], spans["t1"], strict=True):
        at = next((i for i, e in enumerate(ends) if e <= a), len(ends))
        ends[at:at + 1] = [b]
        lane.append(at)
    return spans.assign(lane=lane)


def foci(kills: pd.DataFrame, radius: float = 10.0, scale: tuple[float, float] = (31.0, 16.5)) -> pd.DataFrame:
    """Focus of each kill of a series: the first one that has a kill within `radius` metres; unlocated kills join the first."""
    kills = kills.sort_values(["t", "event_id"], kind="stable")
    # the places met so far, each once, with the first focus that has it: a kill is compared with places, not with kills
    at_place: dict[tuple[float, float], int] = {}
    places, first, n_foci = np.empty((64, 2)), np.empty(64, np.int64), 0
    out = []
    for x, y in zip(kills["x"], kills["y"], strict=True):
        if x is None or y is None or np.isnan(x) or np.isnan(y):
            at = 0
        else:
            n = len(at_place)
            near = first[:n][np.sqrt(((x - places[:n, 0]) * scale[0]) ** 2 + ((y - places[:n, 1]) * scale[1]) ** 2) <= radius]
            at = int(near.min()) if len(near) else n_foci
            if (x, y) not in at_place:
                if n == len(first):
                    places, first = np.concatenate([places, places]), np.concatenate([first, first])
                at_place[x, y], places[n] = n, (x, y)
            first[at_place[x, y]] = at
        n_foci = max(n_foci, at + 1)
        out.append(at)
    return kills.assign(focus=out)


def greedy_pairs(pairs: pd.DataFrame) -> pd.DataFrame:
    """One-to-one matching by ascending (dt, a, b)."""
    pairs = pairs.sort_values(["dt", "a", "b"], kind="stable")
    used: set = set()
    keep = []
    for a, b in zip(pairs["a"], pairs["b"], strict=True):
        keep.append(a not in used and b not in used)
        if keep[-1]:
            used |= {a, b}
    return pairs[keep]


def mutual_pairs(kills: pd.DataFrame, most: float) -> pd.DataFrame:
    """Pairs of kills a and b, b at most `most` seconds after a, in which two players kill each other, each kill once, by ascending (dt, a, b).

    What greedy_pairs keeps of all such pairs, which are many more than kills where kills are dense: of each kill only
    the nearest later one that is still free waits in the heap, so memory grows with the kills. A kill is a row (id, t,
    killer, victim); one of several killers has a row for each, and serves one pair. Of equal times the smaller id is a.
    """
    low, high = kills[["killer", "victim"]].min(axis=1), kills[["killer", "victim"]].max(axis=1)
    kills = kills.assign(low=low, high=high).drop_duplicates(["id", "low", "high"]).sort_values(["low", "high", "t", "id"], kind="stable")
    pair = ((kills["low"] != kills["low"].shift()) | (kills["high"] != kills["high"].shift())).cumsum().tolist()
    ids, t, side, n = kills["id"].tolist(), kills["t"].tolist(), (kills["killer"] < kills["victim"]).astype(int).tolist(), len(kills)
    # by side, where to look on for the first free row of it from a place on; a place that points to itself is one
    ahead = [[i if side[i] == s else i + 1 for i in range(n)] + [n] for s in (0, 1)]
    places: dict = {}
    for i, kill in enumerate(ids):
        places.setdefault(kill, []).append(i)

    def first_free(s: int, i: int) -> int:
        end = i
        while ahead[s][end] != end:
            end = ahead[s][end]
        while ahead[s][i] != end:
            ahead[s][i], i = end, ahead[s][i]
        return end

    waiting: list[tuple] = []

    def wait(i: int) -> None:
        j = first_free(1 - side[i], i + 1)
        if j < n and pair[j] == pair[i] and t[j] - t[i] <= most:
            heapq.heappush(waiting, (t[j] - t[i], ids[i], ids[j], i, j))

    for i in range(n):
        wait(i)
    used: set = set()
    kept = []
    while waiting:
        _, a, b, i, j = heapq.heappop(waiting)
        if a in used:
            continue
        if b in used:
            wait(i)
            continue
        kept.append((i, j))
        used |= {a, b}
        for k in places[a] + places[b]:
            ahead[side[k]][k] = k + 1
    a, b = kills.iloc[[i for i, _ in kept]].reset_index(drop=True), kills.iloc[[j for _, j in kept]].reset_index(drop=True)
    return pd.DataFrame({"game_id": a["game_id"], "p": a["killer"], "q": a["victim"], "ta": a["t"], "a": a["id"], "tb": b["t"], "b": b["id"], "dt": b["t"] - a["t"]})


def ray_cells(x: float, y: float, tx: float, ty: float, n: int) -> list[tuple[int, int]]:
    """Cells of an n * n grid that a line from (x, y) to (tx, ty) passes, in order."""
    px, py, dx, dy = x * n, y * n, (tx - x) * n, (ty - y) * n
    cx, cy, ex, ey = int(px), int(py), int(tx * n), int(ty * n)
    sx, sy = (1 if dx > 0 else -1), (1 if dy > 0 else -1)
    fx = abs(((cx + (dx > 0)) - px) / dx) if dx else np.inf
    fy = abs(((cy + (dy > 0)) - py) / dy) if dy else np.inf
    found = [(cx, cy)]
    while (cx, cy) != (ex, ey) and len(found) <= 4 * n:
        if fx < fy:
            cx, fx = cx + sx, fx + abs(1 / dx)
        else:
            cy, fy = cy + sy, fy + abs(1 / dy)
        if not (0 <= cx < n and 0 <= cy < n):
            break
        found.append((cx, cy))
    return found


def visible(x: float, y: float, blocked: np.ndarray) -> np.ndarray:
    """Which cells are seen from (x, y): the line to a cell's centre passes no blocked cell before it."""
    n = len(blocked)
    out = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            out[i, j] = not any(blocked[c] for c in ray_cells(x, y, (i + 0.5) / n, (j + 0.5) / n, n)[:-1])
    return out


def settled_labels(labels: list[str], step: float, flicker: float = 1.5, ambiguous: str = "amb", never: tuple[str, ...] = ("dead",), widest: float = 1.5) -> list[str]:
    """Labels at even steps without flicker.

    A run shorter than `flicker` between two equal labels takes theirs; a short ambiguous run between two different,
    known ones is shared half and half. The leftmost such run is settled first, until none is left.
    """
    runs: list[list] = []
    for x in labels:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    at = 1
    while at < len(runs) - 1:
        (before, _), (label, n), (after, _) = runs[at - 1:at + 2]
        if n * step < flicker and before == after:
            runs[at - 1:at + 2] = [[before, runs[at - 1][1] + n + runs[at + 1][1]]]
            at = max(1, at - 2)
        elif n * step < flicker and label == ambiguous and n * step <= widest and ambiguous not in (before, after) and not {before, after} & set(never):
            runs[at - 1][1] += n // 2
            runs[at + 1][1] += n - n // 2
            del runs[at]
            at = max(1, at - 2)
        else:
            at += 1
    return [x for x, n in runs for _ in range(n)]


def level_spans(t0: float, t1: float, times: list[float], outside: list[float], sure: list[bool], rides: list[tuple[float, str]], margin: float = 0.02, leave: float = 0.5, up: str = "etage", down: str = "dessous") -> list[tuple[float, float, str, str]]:
    """Contiguous (t0, t1, level, source) of one life: down at first, as rides say, and down again after `leave` seconds
    farther than `margin` outside the upper floor; rows that are not sure say nothing about that."""
    changes = [(t, to, "tp") for t, to in rides if t0 <= t <= t1]
    events = sorted([(t, 0, i) for i, (t, _, _) in enumerate(changes)] + [(t, 1, i) for i, t in enumerate(times)])
    spans: list[tuple[float, float, str, str]] = []
    start, level, source, since = t0, down, "default", None

    def go(t: float, to: str, why: str) -> None:
        nonlocal start, level, source, since
        since = None
        if to != level:
            if t > start:
                spans.append((start, t, level, source))
                start = t
            level, source = to, why

    for t, kind, i in events:
        if kind == 0:
            go(t, changes[i][1], changes[i][2])
        elif level == up and sure[i]:
            since = None if outside[i] <= margin else t if since is None else since
            if since is not None and t - since >= leave:
                go(since, down, "zone")
    return [*spans, (start, t1, level, source)]


def tracked_boxes(rows: pd.DataFrame, near: float = 0.03, gap: float = 4.0, least: float = 20.0, cadence: float = 1.0) -> pd.DataFrame:
    """Boxes that stay in one place: t0, t1, x, y (medians), n; gaps of at most `gap` and lives of at least `least` seconds.

    A box joins the oldest open track whose first place is within `near` on both axes.
    """
    tracks: list[dict] = []
    for t, x, y in rows.sort_values(["t", "x", "y"], kind="stable")[["t", "x", "y"]].itertuples(index=False):
        own = next((k for k in tracks if abs(k["x"] - x) <= near and abs(k["y"] - y) <= near and t - k["t1"] <= gap + cadence), None)
        if own is None:
            own = {"t0": t, "x": x, "y": y, "xs": [], "ys": []}
            tracks.append(own)
        own["t1"] = t
        own["xs"].append(x)
        own["ys"].append(y)
    long = [(k["t0"], k["t1"], float(np.median(k["xs"])), float(np.median(k["ys"])), len(k["xs"])) for k in tracks if k["t1"] - k["t0"] + cadence >= least]
    return pd.DataFrame(sorted(long), columns=["t0", "t1", "x", "y", "n"])


def recoveries(rows: pd.DataFrame, window: float = 0.4, drop: float = 0.07, gap: float = 2.0, flat: float = 0.02, rise: float = 0.05, longest: float = 12.0) -> pd.DataFrame:
    """Damage episodes of one slot with when hit points start to rise again: t_loss, plateau, t_start, why.

    A hit is a value at least `drop` below the highest of the `window` before; hits at most `gap` apart are one episode.
    The rise starts at the end of the flat stretch before the first value `rise` above the lowest since. why is ok, gap
    (unreadable first), hit (another episode first) or none.
    """
    rows = rows.sort_values("t", kind="stable")
    t, hp = rows["t"].to_numpy(float), rows["hp"].to_numpy(float)
    hits = [i for i in range(len(t)) if not np.isnan(hp[i]) and np.nanmax(hp[np.searchsorted(t, t[i] - window - 1e-9):i + 1]) - hp[i] >= drop - 1e-12]
    ends = [i for i, nxt in zip(hits, [*hits[1:], None], strict=True) if nxt is None or t[nxt] - t[i] > gap]
    firsts = [i for i, before in zip(hits, [None, *hits[:-1]], strict=True) if before is None or t[i] - t[before] > gap]
    found = []
    for n, last in enumerate(ends):
        stop = firsts[n + 1] if n + 1 < len(firsts) else len(t)
        low, at, why = hp[last], last, "hit" if stop < len(t) else "none"
        for j in range(last + 1, stop):
            if t[j] - t[last] > longest:
                why = "none"
                break
            if np.isnan(hp[j]):
                why = "gap"
                break
            low = min(low, hp[j])
            if hp[j] >= low + rise:
                why = "ok"
                break
            if hp[j] <= low + flat:
                at = j
        found.append((t[last], low, t[at] if why == "ok" else np.nan, why))
    return pd.DataFrame(found, columns=["t_loss", "plateau", "t_start", "why"])


def decimated(points: pd.DataFrame, least: float, scale: tuple[float, float] = (31.0, 16.5)) -> pd.DataFrame:
    """Points of a path at least `least` metres from the last one kept; the first and last stay."""
    points = points.sort_values("t", kind="stable")
    keep, last = [], None
    xy = points[["x", "y"]].to_numpy(float)
    for i, (x, y) in enumerate(xy):
        far = last is None or np.hypot((x - last[0]) * scale[0], (y - last[1]) * scale[1]) >= least
        keep.append(bool(far or i == len(xy) - 1))
        last = (x, y) if keep[-1] else last
    return points[keep]


def best_assignment(costs: np.ndarray, margin: float = 0.1) -> list[int] | None:
    """Column of each row at the least total cost; None if another assignment is less than `margin` worse. At most 4 x 4."""
    from itertools import permutations

    totals = sorted((sum(costs[i, j] for i, j in enumerate(p)), p) for p in permutations(range(costs.shape[1]), costs.shape[0]))
    if not totals or (len(totals) > 1 and totals[1][0] - totals[0][0] < margin):
        return None
    return list(totals[0][1])
