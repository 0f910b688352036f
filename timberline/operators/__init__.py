from .gc import collect_versions, history_prune, snapshot_count, watermark
from .merge import concat_runs, merge_kway, merge_two, overlay, runs_disjoint
from .occ import occ_conflicts, occ_fold
from .segments import freeze_segments, live_bytes
from .snapshot import asof_join, batch_last_wins, multi_get, point_get, raw_versions, snapshot

__all__ = ["asof_join", "batch_last_wins", "collect_versions", "concat_runs", "freeze_segments", "history_prune", "live_bytes", "merge_kway", "merge_two", "multi_get", "occ_conflicts", "occ_fold", "overlay", "point_get", "raw_versions", "runs_disjoint", "snapshot", "snapshot_count", "watermark"]
