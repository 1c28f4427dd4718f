"""Hand-made matches as frames: every case is a game of its own, so that one run of an operator serves many cases."""

import numpy as np

DURATION = 200.0
A_SPAWN, B_SPAWN, MID = (0.15, 0.6), (0.80, 0.6), (0.485, 0.54)
FAR_A, FAR_B = (0.05, 0.1), (0.95, 0.1)
#: Starting zones of the one-point map, one for each team, and the frame of its point.
ZONES = {"A": (0.08, 0.45, 0.22, 0.75), "B": (0.73, 0.45, 0.87, 0.75)}
POINT = (0.44, 0.46, 0.53, 0.62)


def track(points):
    """t -> (x, y) along straight lines between (t, (x, y)), still before the first and after the last."""
    times, places = [t for t, _ in points], np.array([p for _, p in points])
    return lambda t: tuple(float(np.interp(t, times, places[:, axis])) for axis in (0, 1))


def stay(p):
    return lambda t: p


def leave(spawn, t_leave, t_arrive, dest=MID):
    return track([(t_leave, spawn), (t_arrive, dest)])


def whole(path):
    return [(0.0, DURATION, "end", path)]


def dying(slot, t, path):
    """A life that ends at t and one that starts 17 s later at the team's spawn."""
    return [(0.0, t, "death", path), (t + 17.0, DURATION, "end", stay(A_SPAWN if slot <= 4 else B_SPAWN))]


class Matches:
    """Games by name, and the frames of all of them."""

    def __init__(self):
        self.ids, self.lives, self.samples, self.kills, self.hp, self.owners = {}, [], [], [], [], []

    def add(self, name, players, kills=(), hp=None, owners=(), step=0.5, spawn=True):
        game = self.ids[name] = len(self.ids) + 1
        for slot in range(1, 9):
            home = A_SPAWN if slot <= 4 else B_SPAWN
            for idx, (t0, t1, ended, path) in enumerate(players.get(slot, whole(stay(home)) if spawn else [])):
                (x0, y0), (x1, y1) = path(t0), path(t1)
                self.lives.append((game, slot, idx, t0, t1, x0, y0, x1, y1, ended))
                self.samples += [(game, slot, t0 + i * step, *path(t0 + i * step), True) for i in range(int((t1 - t0) / step + 1e-9) + 1)]
        self.kills += [(game, float(t), k, v, "kill") for t, k, v in kills]
        self.owners += [(game, "A", float(a), float(b), o) for a, b, o in owners]
        for slot, points in (hp or {}).items():
            value = track([(t, (v, 0.0)) for t, v in points])
            self.hp += [(game, slot, round(i * 0.1, 3), value(i * 0.1)[0]) for i in range(int(points[0][0] * 10) - 20, min(2001, int(points[-1][0] * 10) + 160))]
        return game

    def frames(self, spark):
        make = spark.createDataFrame
        return {
            "lives": make(self.lives, "game_id long, slot int, idx int, t0 double, t1 double, x0 double, y0 double, x1 double, y1 double, ended string"),
            "samples": make(self.samples, "game_id long, slot int, t double, x double, y double, alive boolean"),
            "kills": make(self.kills, "game_id long, t double, killer_slot int, victim_slot int, kind string"),
            "hp": make(self.hp, "game_id long, slot int, t double, hp double"),
            "owners": make(self.owners, "game_id long, point string, t0 double, t1 double, owner string"),
            "games": make([(g, DURATION) for g in self.ids.values()], "game_id long, duration double"),
        }

    def rows(self, df):
        """Rows by the game's name."""
        names = {g: n for n, g in self.ids.items()}
        out = {n: [] for n in self.ids}
        for r in df.collect():
            out[names[r["game_id"]]].append(r)
        return out
