"""The multi-hypothesis tracker of one session as a plain state function.

A frame is a list of observations. Near ones merge, live tracks take the cheapest one each in
the order they were opened, the rest open new tracks, dead tracks go, and the best track that is
being tracked, if it has come far enough, gives the location. Only the last observation of a track,
its anchor and counters are kept, so a session's state is bounded by its live tracks.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

INITIALIZING, TRACKING, LOST, DEAD = "Initializing", "Tracking", "Lost", "Dead"

#: The reasons that users read.
NO_TRACK = "No active trajectories available in estimator"
NONE_TRACKING = "No trajectories in Tracking state (Initializing: {initializing}, Lost: {lost})"
SHORT_SPAN = "Insufficient spatial span: max current span is {longest:.2f}m, required {required:.2f}m"


@dataclass(frozen=True)
class Config:
    hover: float = 0.5
    init_hits: int = 3
    dead_frames: int = 5
    cutoff: float = 15.0
    nms_radius: float = 0.2
    min_span: float = 2.0


@dataclass
class Track:
    """``anchor`` is where distances are measured from; a hovering track shows ``last`` but keeps it."""

    last: dict
    anchor: list[float]
    inliers: int
    state: str = INITIALIZING
    health: float = 15.0
    hits: int = 1
    failures: int = 0
    span: float = 0.0


def place(p: dict) -> list[float]:
    return [p["ecef_x"], p["ecef_y"], p["ecef_z"]]


def merge_near(points: list[dict], radius: float) -> list[dict]:
    kept: list[dict] = []
    for p in points:
        if all(sum((a - b) ** 2 for a, b in zip(place(p), place(o), strict=True)) >= radius * radius for o in kept):
            kept.append(p)
    return kept


def assign(tracks: list[Track], points: list[dict], cutoff: float) -> dict[int, int]:
    """Track to observation: in order, each the cheapest still free one under the cutoff, first on ties."""
    free = dict.fromkeys(range(len(points)))
    out = {}
    for t, track in enumerate(tracks):
        costs = [(math.dist(track.anchor, place(points[k])) + 10.0 / (points[k]["inliers"] + 1), k) for k in free]
        cost, k = min(costs, default=(cutoff, -1))
        if cost < cutoff:
            out[t] = k
            del free[k]
    return out


def hit(track: Track, p: dict, config: Config) -> None:
    # rotating to local axes keeps distances, so steps are measured in ECEF
    step = math.dist(track.anchor, place(p))
    track.failures, track.hits, track.health = 0, track.hits + 1, min(track.health + 1, 20.0)
    track.last = p
    if step >= config.hover:
        track.anchor = place(p)
        track.inliers += p["inliers"]
        track.span += step
    if track.state == LOST or (track.state == INITIALIZING and track.hits >= config.init_hits):
        track.state = TRACKING


def miss(track: Track, config: Config) -> None:
    track.failures, track.hits, track.health = track.failures + 1, 0, track.health - 3
    if track.state == TRACKING:
        track.state = LOST
    elif track.state == INITIALIZING or track.failures > config.dead_frames or track.health <= 0:
        track.state = DEAD


def decide(tracks: list[Track], config: Config) -> dict:
    """status, reason and the winning observation; of equal tracks the latest opened wins."""
    uncertain = lambda reason: {"status": "uncertain", "reason": reason, "point": None}
    if not tracks:
        return uncertain(NO_TRACK)
    live = [t for t in tracks if t.state == TRACKING]
    if not live:
        count = lambda s: sum(t.state == s for t in tracks)
        return uncertain(NONE_TRACKING.format(initializing=count(INITIALIZING), lost=count(LOST)))
    far = [(t.inliers, t.span, k) for k, t in enumerate(live) if t.span >= config.min_span]
    if not far:
        return uncertain(SHORT_SPAN.format(longest=max(t.span for t in live), required=config.min_span))
    return {"status": "location", "reason": None, "point": live[max(far)[2]].last}


def step(tracks: list[Track], points: list[dict], config: Config) -> tuple[list[Track], dict]:
    points = merge_near(points, config.nms_radius)
    taken = assign(tracks, points, config.cutoff)
    for t, track in enumerate(tracks):
        if t in taken:
            hit(track, points[taken[t]], config)
        else:
            miss(track, config)
    new = [Track(p, place(p), p["inliers"]) for k, p in enumerate(points) if k not in set(taken.values())]
    tracks = [t for t in [*tracks, *new] if t.state != DEAD]
    return tracks, decide(tracks, config)


@dataclass
class Session:
    """State of one session: tracks, and the place to look near (only fed back if asked for)."""

    tracks: list[Track] = field(default_factory=list)
    prior: dict | None = None

    def frame(self, status: str, points: list[dict], config: Config, feedback: bool = False) -> dict:
        """``status``: ok, error (nothing passed the gate: the prior goes) or uncertain (no homography).
        Frames that are not ok bypass the tracks and age none."""
        mode = "crop" if self.prior else "retrieve"
        if status == "error":
            self.prior = None
            result = {"status": "error", "reason": "No tile with enough matches", "point": None}
        elif status == "uncertain":
            result = {"status": "uncertain", "reason": "No homography", "point": None}
        else:
            self.tracks, result = step(self.tracks, points, config)
        if feedback and result["status"] == "location":
            p = result["point"]
            self.prior = {k: p.get(k) for k in ("pixel_x", "pixel_y", "lon", "lat")}
        return result | {"mode": mode, "tracks": len(self.tracks)}

    def dump(self) -> dict:
        return {"tracks": [asdict(t) for t in self.tracks], "prior": self.prior}

    @classmethod
    def load(cls, state: dict) -> Session:
        return cls([Track(**t) for t in state["tracks"]], state["prior"])
