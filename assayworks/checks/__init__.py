"""The checks: evidence tables in, violations and scores out, for all subjects at once."""

from assayworks.checks.access import (
    acl_check, can_read_check, can_write_check, permission_check)
from assayworks.checks.arguments import args_check
from assayworks.checks.code import lint_check, paths_check, urls_check
from assayworks.checks.config import config_check, config_checks
from assayworks.checks.exposure import dependency_check, scan_check
from assayworks.checks.jobs import job_log_check
from assayworks.checks.outcome import Outcome

__all__ = [
    "Outcome", "acl_check", "args_check", "can_read_check", "can_write_check", "config_check",
    "config_checks", "dependency_check", "job_log_check", "lint_check", "paths_check", "permission_check",
    "scan_check", "urls_check",
]
