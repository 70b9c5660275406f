"""Fixed values that results must agree on.

FIXED VALUES — these lists, names and texts define the output and must not be
altered: log patterns, event and method names, the binary names counted as
living-off-the-land tools, the ATT&CK technique table, severity order, action
names and message texts.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Log line patterns (Java regex; searched anywhere in the line).
RE_SSH_FAILED = r"(\w+ +\d+ [\d:]+) .+ sshd\[\d+\]: .*Failed password for (.*) from ([\d.]+) port (\d+)"
RE_SSH_SUCCESS = r"(\w+ +\d+ [\d:]+) .+ sshd\[\d+\]: .*[Aa]ccepted (\w+) for (\w+) from ([\d.]+) port (\d+)"
RE_SSH_INVALID = r"(\w+ +\d+ [\d:]+) .+ sshd\[\d+\]: .*Invalid user (\w+) from ([\d.]+) port (\d+)"
RE_SUDO_SUCCESS = r"(\w+ +\d+ [\d:]+) .+ sudo: (\w+) : TTY=(\S+) ; PWD=(\S+) ; USER=(\w+) ; COMMAND=(.+)"
RE_SUDO_FAILURE = r"(\w+ +\d+ [\d:]+) .+ sudo: (\w+) : command not allowed"
RE_AUDIT_EXECVE = r"type=EXECVE msg=audit\(\d+\.\d+:\d+\): .*exe=\"([^\"]+)\""
RE_AUDIT_EPOCH = r"msg=audit\((\d+\.\d+):"

# Event types and auth methods produced by the parser.
EV_LOGIN_FAILED = "login_failed"
EV_LOGIN_SUCCESS = "login_success"
EV_INVALID_USER = "invalid_user_attempt"
EV_SUDO_SUCCESS = "sudo_success"
EV_SUDO_FAILURE = "sudo_failure"
EV_PROCESS_EXEC = "process_execution"
EV_UNKNOWN = "unknown"

# Binary names counted as living-off-the-land tools (26 names).
LOLBINS = (
    "bash", "sh", "python", "perl", "ruby", "php",
    "curl", "wget", "nc", "netcat", "telnet",
    "find", "grep", "awk", "sed",
    "tar", "zip", "gzip",
    "dd", "cp", "mv", "chmod",
    "gcc", "make",
    "git", "svn",
)

# Commands counted as account or permission changes (intended semantics of the
# account-change slot).
ACCOUNT_CHANGE_COMMANDS = ("useradd", "usermod", "passwd", "groupmod", "chmod", "chown")

# Feature vector: names in the fixed order of the 14 slots.
FEATURE_NAMES = (
    "ip_failed_logins",
    "ip_unique_users_attempted",
    "ip_failed_to_success_ratio",
    "ip_avg_inter_attempt_seconds",
    "ip_auth_method_variance",
    "user_login_time_std_devs",
    "user_new_ip_detected",
    "user_first_sudo_usage",
    "user_failed_sudo_attempts",
    "user_login_from_new_asn",
    "session_login_to_privesc_seconds",
    "session_post_login_command_rate",
    "session_lolbin_executed",
    "session_account_changes",
)

# ATT&CK tactics (12) and techniques (15): id, name, tactic, description, indicators.
TACTICS = (
    "Initial Access", "Execution", "Persistence", "Privilege Escalation",
    "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement",
    "Collection", "Command and Control", "Exfiltration", "Impact",
)

TECHNIQUES = (
    ("T1110", "Brute Force", "Credential Access",
     "Attacker uses brute force techniques to guess credentials",
     ("Multiple failed login attempts from single IP", "Rapid sequential login attempts",
      "Invalid user enumeration", "High failure-to-success ratio")),
    ("T1110.001", "Brute Force: Password Guessing", "Credential Access",
     "Attacker guesses passwords through repeated attempts",
     ("Repeated failed password attempts", "Failed logins followed by success",
      "Failed authentication within seconds of success")),
    ("T1110.004", "Brute Force: Credential Stuffing", "Credential Access",
     "Attacker uses previously compromised credentials",
     ("Login from unusual geographic location", "Login from new IP address",
      "Login at unusual time of day")),
    ("T1078", "Valid Accounts", "Defense Evasion",
     "Attacker uses legitimate credentials for access",
     ("Successful login from new IP", "Login at unusual time",
      "Unusual geographic location", "Successful login after failed attempts")),
    ("T1078.001", "Valid Accounts: Local Accounts", "Defense Evasion",
     "Attacker uses local system accounts",
     ("Successful login for system user", "Sudo usage by system account",
      "Permission changes by system account")),
    ("T1548", "Abuse Elevation Control Mechanism", "Privilege Escalation",
     "Attacker abuses elevation mechanisms like sudo",
     ("Sudo usage immediately after login", "Failed sudo attempts",
      "Sudo usage for non-standard commands", "Sudo usage outside normal user pattern")),
    ("T1548.003", "Abuse Elevation Control Mechanism: Sudo and Sudo Caching", "Privilege Escalation",
     "Attacker abuses sudo to escalate privileges",
     ("Rapid sudo invocations", "Failed sudo attempts followed by success",
      "Sudo usage outside normal TTY")),
    ("T1098", "Account Manipulation", "Persistence",
     "Attacker modifies account properties for persistence",
     ("SSH key addition", "Account password change", "Group membership modification",
      "User account creation")),
    ("T1547", "Boot or Logon Autostart Execution", "Persistence",
     "Attacker modifies startup mechanisms for persistence",
     ("Modification of rc scripts", "Modification of crontab", "Addition of systemd services")),
    ("T1059", "Command and Scripting Interpreter", "Execution",
     "Attacker executes commands through shell",
     ("Shell command execution", "Script execution", "Interactive shell access", "Command chaining")),
    ("T1059.004", "Command and Scripting Interpreter: Unix Shell", "Execution",
     "Attacker uses Unix shell for command execution",
     ("Bash invocation", "Shell script execution", "Interactive SSH shell usage")),
    ("T1105", "Ingress Tool Transfer", "Command and Control",
     "Attacker transfers tools to target system",
     ("curl/wget execution", "File transfer tool usage", "Downloaded tool execution")),
    ("T1070", "Indicator Removal on Host: Clear Linux/Mac History", "Defense Evasion",
     "Attacker clears audit logs to hide activity",
     ("Log file truncation", "Audit log clearing", "History file deletion",
      "Suspicious rm commands on log files")),
    ("T1087", "Account Discovery", "Discovery",
     "Attacker enumerates user accounts",
     ("getent/cat of passwd file", "Enumeration of sudoers", "User enumeration commands")),
    ("T1217", "Browser Bookmark Discovery", "Discovery",
     "Attacker searches for sensitive files",
     ("Recursive directory searches", "Find command for sensitive patterns",
      "Grep for credentials in files")),
)

# Severity order.
SEVERITY_LEVELS = ("NORMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")

# Per-action cooldown seconds (default 300). The executor
# name written into audit rows names this engine.
ACTION_COOLDOWN_SECONDS = {"lock_account": 300, "block_ip": 600, "terminate_session": 180}
DEFAULT_COOLDOWN_SECONDS = 300
EXECUTED_BY = "authlytics_engine"

# Explanation texts.
EXPLAIN_NORMAL = "Event appears normal"
EXPLAIN_MISSING = "Unable to generate explanation"
EXPLAIN_UNCLEAR = "Anomaly detected but specific factors unclear"
EXPLAIN_PREFIX = "Possible attack detected: "

# Response message texts.
MSG_COOLDOWN = "Action blocked by cooldown (cooldown: %ds)"
MSG_DRY_RUN = "Automated actions disabled (dry-run mode)"

# Operational recommendations.
REC_NORMAL = "System performing normally."
# ------------------------------------------------------------ END FIXED VALUES
