"""Run parameters, passed explicitly to the plan builders."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Params:
    # trailing feature window; an event at e is in the window of t when e > t - w
    window_seconds: float = 300.0
    # time bucket of the (key, bucket) split that keeps a hot IP or user from
    # becoming a single task; must be >= window_seconds
    bucket_seconds: float = 3600.0
    # "delta": running sums of +1/-1 events (linear in rows, skew-safe);
    # "frame": RANGE window frames (simple; cost grows with rows per window)
    window_method: str = "delta"
    # with a number: events are stored and counted first, and an IP or user with more rows in
    # a bucket is worked on in blocks of about that many (needs window_method "delta")
    hot_rows: int | None = None
    # reproduce accidental reference behaviour (new-IP, first-sudo, LOLBin test,
    # declared-but-never-filled slots) instead of the intended semantics
    compat: bool = False
    # year for the yearless syslog stamp; None: the latest that doesn't lie after the ingest
    log_year: int | None = None
    # rule thresholds (the reference hard-codes these literals)
    failed_login_threshold: int = 5
    unique_users_threshold: int = 5
    failure_ratio_threshold: float = 0.7
    stuffing_ratio_threshold: float = 0.5
    failed_sudo_threshold: int = 3
    rapid_privesc_seconds: float = 60.0
    # model
    n_trees: int = 100
    max_samples: int = 256
    contamination: float = 0.1
    seed: int = 42
    # "paper": anomaly score = -score_samples in (0, 1]; "logistic": 1/(1+exp(s))
    score_mode: str = "paper"
    min_training_rows: int = 1000
    # risk cut-offs
    low_threshold: float = 0.4
    medium_threshold: float = 0.6
    high_threshold: float = 0.8
    critical_threshold: float = 0.9
    # response
    lock_account_at: str = "HIGH"
    block_ip_at: str = "HIGH"
    terminate_session_at: str = "CRITICAL"
    enable_actions: bool = False
    cooldowns: dict = field(default_factory=lambda: {
        "lock_account": 300, "block_ip": 600, "terminate_session": 180})
    default_cooldown: int = 300

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    def __post_init__(self):
        if self.bucket_seconds < self.window_seconds:
            raise ValueError("bucket_seconds must be >= window_seconds")
        if self.window_method not in ("delta", "frame"):
            raise ValueError("window_method must be 'delta' or 'frame'")
        if self.hot_rows is not None and (self.hot_rows < 1 or self.window_method != "delta"):
            raise ValueError("hot_rows needs window_method 'delta' and a positive number")

    def __hash__(self):  # equal parameters have equal hashes: the dict by its sorted items
        return hash(tuple(tuple(sorted(v.items())) if isinstance(v, dict) else v for v in vars(self).values()))


DEFAULT = Params()
