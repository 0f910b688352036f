from .leveled import Task, amplification, apply_task, file_overlap, key_range, level_sizes, level_targets, live_files, plan_full, plan_leveled, pruned_files, read_amplification, split_ranges

__all__ = ["Task", "amplification", "apply_task", "file_overlap", "key_range", "level_sizes", "level_targets", "live_files", "plan_full", "plan_leveled", "pruned_files", "read_amplification", "split_ranges"]
