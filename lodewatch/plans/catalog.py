"""Risk rules as data. Patterns are written for ASCII word edges and Unicode white space; ``functions.patterns`` spells them out.

A repeat of a group is possessive where the group can't give back, so that long texts don't exhaust Java's stack.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``names`` are globs of file names. A pattern with a group ``finding`` is placed where the group's text first stands
    in the match. ``view`` names the text that is matched: "raw" or a view of ``functions.views``.
    Where ``escalated`` names a severity and a view, matches in that view come first and have that severity. A rule with
    ``scopes`` holds for settings files that are installed in one of them."""

    rule_id: str
    severity: str
    category: str
    names: tuple[str, ...]
    patterns: tuple[str, ...]
    message: str
    view: str = "raw"
    scopes: tuple[str, ...] = ()
    escalated: tuple[str, str] | None = None


# fixed values: file kinds
PY, SH, JS, MD = ("*.py",), ("*.sh", "*.bash"), ("*.js", "*.ts", "*.mjs"), ("*.md",)
JS_ALL = ("*.js", "*.ts", "*.mjs", "*.cjs", "*.jsx", "*.tsx")
PROMPTS = ("*.md", "*.mdc", "SKILL.md", "AGENTS.md")
PAGES = (*PROMPTS, "*.html")
SCRIPTS = (*PY, *SH, *JS)
SKILLS = ("*.md", "*.mdc", "SKILL.md", "AGENTS.md", "CLAUDE.md", "GEMINI.md", ".cursorrules", ".windsurfrules")
SKILLS_AND_CODE = (*SKILLS, "*.sh", "*.bash", "*.js", "*.ts", "*.mjs", "*.cjs", "*.py")
TEXTS = ("*.md", "*.mdc", "*.txt", "*.sh", "*.bash", *JS_ALL, "*.py", "SKILL.md", "AGENTS.md", "CLAUDE.md", "GEMINI.md")
DECODERS = ("*.md", "*.mdc", "*.txt", "*.sh", "*.bash", "*.ps1", "SKILL.md", "AGENTS.md", "CLAUDE.md", "GEMINI.md")

SETTINGS = ("settings.json", "settings.local.json")

# fixed values: parts of patterns
STARTUP = r"(?:\"(?:command|args)\"\s*:|\b(?:command|args)\s*=)[\s\S]{0,800}?"
ENV_DUMP = r"(?:(?:/usr)?/bin/)?(?:env|printenv|export(?:\s+-p)?|declare\s+-[px]|set)"
STAGE = r"(?:[^#;&|\n]|\\\r?\n)"
DATA_FLAG = r"(?:-[A-Za-z]*[dF]|--data(?:-ascii|-binary|-raw|-urlencode)?|--form|--post-data|--body-data)"
DUMP_SUBSTITUTION = rf"(?:\$\(|`|<\()\s*{ENV_DUMP}\s*(?:\|[^)`\n]{{0,80}})?[)`]"
STDIN = r"(?:-|/dev/stdin)(?![\w/.-])"
OFFICIAL = r"api\.anthropic\.com|bedrock-runtime(?:-fips)?\.[a-z0-9-]+\.amazonaws\.com|[a-z0-9.-]+\.api\.aws|(?:[a-z0-9-]+-)?aiplatform\.googleapis\.com|[a-z0-9-]+\.services\.ai\.azure\.com|api\.openai\.com"
HOME = r"(?:~|\$HOME|\$\{HOME\})\"?/"
STORE_END = r"(?![A-Za-z0-9._/-]| [A-Za-z0-9._-])"
UP = r"(?:\.\./){2,}"
METADATA = r"https?://(?:169\.254\.169\.254/latest/meta-data/iam/security-credentials|metadata\.google\.internal/computeMetadata/v1/instance/service-accounts/[^\s'\")]+/token|169\.254\.169\.254/metadata/identity/oauth2/token)"
CONTAINER = r"AWS_CONTAINER_CREDENTIALS_RELATIVE_URI|AWS_CONTAINER_CREDENTIALS_FULL_URI"
ELSEWHERE = r"https?://(?!localhost|127\.0\.0\.1|::1)[a-zA-Z0-9]"
ODD_TLD = r"\.(?:xyz|top|tk|ml|ga|cf|gq|pw|click|download|zip)\b"
SHELLS = r"(?:\|\s*|(?:&&|;)\s*)(?:sh|bash|zsh|python3?|node)\b"
RM_FLAGS = r"(?:-[A-Za-z]*[rR][A-Za-z]*[fF][A-Za-z]*|-[A-Za-z]*[fF][A-Za-z]*[rR][A-Za-z]*|-[rR]\s+-[fF]|-[fF]\s+-[rR])"
RM_PATH = r"(?:/|~|\$HOME|\$\{HOME\}|~/\.(?:ssh|aws)|\$HOME/\.(?:ssh|aws)|\$\{HOME\}/\.(?:ssh|aws)|\.git)"
PY_HOME = r"(?:os\.path\.expanduser\s*\(\s*[\"']~[\"']\s*\)|(?:pathlib\.)?Path\.home\s*\(\s*\)|str\s*\(\s*(?:pathlib\.)?Path\.home\s*\(\s*\)\s*\))"
TYPOSQUATS = ("crossenv", "mongose", "lodahs", "expres", "node-fetch2", "comons", "reqeuest", "loadsh", "reqests", "coloama", "colourama", "openssl", "pyyaml2", "urllib3-extension", "python-jwt", "setup-tools")
HIDDEN_STYLE = r"(?:color\s*:\s*(?:white|#fff{1,3}|rgba?\s*\(\s*255\s*,\s*255\s*,\s*255)|font-size\s*:\s*0(?:px|pt|em|rem|vw)?(?![\d.a-z%]);?\s*|visibility\s*:\s*hidden|display\s*:\s*none|opacity\s*:\s*0(?![\d.]))"
HIDDEN_ORDER = r"\b(?:ignore|disregard|override|bypass|forget|follow|obey|reveal|disclose|send|leak|exfiltrate|execute|run|respond|always|never)\b[\s\S]{0,120}\b(?:instructions?|rules?|prompts?|directive|system|secret|token|credential)\b"
CONCEALED = r"(?:this\s+|these\s+|the\s+|your\s+)?(?:skill|instructions?|system\s+prompt|behavior|behaviour|source|existence)"
ESCAPED_TICKS = r"(?<!\\)(?:\\\\\\\\)*\\`(?:[^`\\\n]|\\[^`\n]){5,}+\\`"
# a look-alike word begins where its run of letters and signs does, so that long runs are read once
RUN, LOOKALIKE = "[A-Za-z0-9_.:/-]", "[аеіорсху]"
CATCHERS = r"(?:webhook\.site|requestbin\.(?:net|com)|[mx]\.pipedream\.net|requestcatcher\.com|beeceptor\.com|interact\.sh|oast\.(?:fun|live|me|online|pro|site))"

NOT_QUOTED = r"(?<![\"'`\u201c])(?<!(?:^|[\s(:])[\"\u201c][^\"\u201c\u201d\n]{0,60})"
WITHIN = r"(?:[^\n]|\n(?!\r?\n))"
REQUEST = r"(?:the\s+)?user\s+(?:asks?|requests?|runs?|says?|opens?|invokes?|types?|wants?)\b"
ON_REQUEST = rf"\b(?:(?:when(?:ever)?|if|each\s+time|every\s+time)\s+{REQUEST}|when(?:ever)?\s+asked\b)"
ASIDE = r"\b(?:also|additionally|silently|quietly|secretly|covertly)\b,?\s+(?:[a-z]+ly\s+)?"
EACH_TIME = rf"\b(?:(?:whenever|each\s+time|every\s+time)\b(?!\s+{REQUEST})|(?:before|after)\s+(?:you|each|every|responding|answering|replying)\b)"
LOCAL_DATA = (
    r"(?:\bworking\s+director(?:y|ies)|\bcwd\b|\bpwd\b|\bgit\s+remotes?|\bremote\s+urls?|\b(?:file|source|project|repo(?:sitory)?)\s+(?:contents?|code)"
    r"|\bcontents\s+of\s+(?:the\s+|this\s+|each\s+|every\s+|its\s+|their\s+)?(?:files?|repo(?:sitory)?|project|workspace|director(?:y|ies)|folder)"
    r"|\benvironment\s+variables?|\benv\s+vars?|\.env\b|process\.env|os\.environ|\bcredentials?|\bapi[_\s-]?keys?|\b(?:access|auth|api|bearer|session)\s+tokens?|\bsecrets?\b|\bpasswords?"
    r"|\b(?:ssh|private)\s+keys?|\.ssh\b|\.aws\b|\$[A-Z_]{3,}|\bconversation|\bchat\s+history|\bsystem\s+prompt|\bhostname|\b(?:shell|bash|command)\s+history)"
)
OUTSIDE = r"[<(`\"']?(?!(?:https?://)?(?:localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])(?::\d+)?(?:[/?#\s\"'>)`]|$))(?:https?://|[a-z0-9-]+\.[a-z0-9.-]+/)"
SENDS = rf"(?:\b(?:send|post|upload|report|forward|transmit|submit)s?\b{WITHIN}{{0,80}}?{LOCAL_DATA}{WITHIN}{{0,120}}?\b(?:to|at)\s+{OUTSIDE}|\b(?:include|attach|append|embed)s?\b{WITHIN}{{0,80}}?{LOCAL_DATA}{WITHIN}{{0,120}}?\b(?:request|call)s?\s+to\s+{OUTSIDE})"
IN_CALL, IN_LIST = r"\(", r"(?<!,[ \t\r\n]{0,40})\["
ZIP_FLAG = r"(?:-[A-Za-z0-9]{0,8}[Pe]|--(?:password|encrypt)\b)"
BEFORE = r"(?:^|[\s\"'=:(>/])"
CLAUDE_FILES = r"~[/\\]\.claude[/\\](?:CLAUDE(?:\.local)?\.md\b|settings(?:\.local)?\.json\b|(?:commands|agents|skills)[/\\]|plugins[/\\][^#\n]+[/\\](?:commands|agents|skills)[/\\])"
AGENT_FILES = rf"(?:{CLAUDE_FILES}|~[/\\]\.cursor[/\\]|~[/\\]\.codex[/\\](?:AGENTS(?:\.override)?\.md|config\.toml)\b|{BEFORE}\.codex[/\\]config\.toml\b|~[/\\]\.gemini[/\\](?:settings\.json\b|agents[/\\])|~[/\\]\.agents[/\\]skills[/\\]|{BEFORE}(?:CLAUDE|AGENTS|GEMINI)\.md\b|{BEFORE}AGENTS\.override\.md\b|\.cursorrules\b|\.windsurfrules\b)"
WRITES = r"(?:(?:[Ww]rite|[Aa]ppend|[Ee]cho|[Pp]rintf)\b|[Cc]at\s+>>?|[Tt]ee(?:\s+-a)?\b)"
FILE_WRITES = rf"fs\.(?:writeFile|appendFile)(?:Sync)?\s*\([^#\n]*{AGENT_FILES}|open\s*\([^#\n]*{AGENT_FILES}[^#\n]*,\s*[\"'][wa]"
NOT_FORBIDDEN = r"(?![^#\n]*\b(?:[Mm]ust\s+[Nn][Oo][Tt]|[Dd]o\s+[Nn]ot|[Nn]ever)\b)"
# the pictographs, modifiers and modifier bases of Unicode 15.1
PICTOGRAPHS = "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2605 2607-2612 2614-2685 2690-2705 2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2767 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F000-1F0FF 1F10D-1F10F 1F12F 1F16C-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1E5 1F201-1F20F 1F21A 1F22F 1F232-1F23A 1F23C-1F23F 1F249-1F3FA 1F400-1F53D 1F546-1F64F 1F680-1F6FF 1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F 1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD"
MODIFIER_BASES = "261D 26F9 270A-270D 1F385 1F3C2-1F3C4 1F3C7 1F3CA-1F3CC 1F442-1F443 1F446-1F450 1F466-1F478 1F47C 1F481-1F483 1F485-1F487 1F48F 1F491 1F4AA 1F574-1F575 1F57A 1F590 1F595-1F596 1F645-1F647 1F64B-1F64F 1F6A3 1F6B4-1F6B6 1F6C0 1F6CC 1F90C 1F90F 1F918-1F91F 1F926 1F930-1F939 1F93C-1F93E 1F977 1F9B5-1F9B6 1F9B8-1F9B9 1F9BB 1F9CD-1F9CF 1F9D1-1F9DD 1FAC3-1FAC5 1FAF0-1FAF8"


def characters(ranges: str) -> str:
    """The inside of a class of characters that holds these code points."""
    return "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in ranges.split())


def called(names: str, opener: str = rf"(?:{IN_CALL}|{IN_LIST})") -> str:
    """A quoted command that opens a call or a list."""
    return rf"[\"'](?<={opener}[ \t\r\n]{{0,40}}[\"'])(?:[^\"'\n]{{0,120}}[\\/])?(?:{names})(?:\.exe)?[\"']"


EMOJI, KEYCAP = characters(PICTOGRAPHS), r"[#*0-9]\x{FE0F}\x{20E3}"

# fixed values: rule ids, severities, file kinds, patterns and messages
RULES = (
    Rule("CODEEXEC-PY-EVAL", "critical", "code-execution", PY, (r"\beval\s*\(",), "Python eval() call — arbitrary code execution risk.", "code"),
    Rule("CODEEXEC-PY-OSSYS", "critical", "code-execution", PY, (r"\bos\.system\s*\(", r"\bos\.popen\s*\(", r"\bsubprocess\.(?:call|run|Popen|check_output|check_call)\s*\([\s\S]{0,500}?\bshell\s*=\s*True\b", r"\bsubprocess\.(?:call|run|Popen|check_output|check_call)\s*\(\s*(?:[rbufRBUF]*['\"]|[rbufRBUF]*f['\"])"), "Python OS command execution — command injection risk.", "code"),
    Rule("CODEEXEC-JS-EVAL-FUNCTION", "critical", "code-execution", JS_ALL, (r"\beval\s*\(", r"\bnew\s+Function\s*\("), "JavaScript eval() or new Function() — arbitrary code execution risk.", "code"),
    Rule("CODEEXEC-JS-CHILDPROCESS-SHELL", "critical", "code-execution", (*JS, "*.cjs"), (r"require\s*\(\s*['\"]child_process['\"]\s*\)", r"\bshell\s*:\s*true\b"), "child_process with shell:true — command injection risk.", "code"),
    Rule("CODEEXEC-DESERIALIZE", "high", "code-execution", ("*.py", "*.rb", "*.php", "*.js", "*.ts"), (r"\bpickle\.loads?\s*\(", r"\byaml\.load\s*\(", r"\bunserialize\s*\(", r"\bMarshal\.load\s*\("), "Unsafe deserialization — may allow arbitrary code execution via crafted input.", "code"),
    Rule("CODEEXEC-SHELL-BACKTICK", "high", "code-execution", SH, (r"(?<!\\)(?:\\\\)*`(?:[^`\\\n]|\\.){5,}+`", rf"\b(?:eval|trap|(?:ba|da|k|z)?sh\s+-(?=[a-z]*c)[a-z]+)\s+\"(?:[^\"\\\n]|(?!{ESCAPED_TICKS})\\.)*+{ESCAPED_TICKS}"), "Shell backtick command substitution — executes arbitrary commands.", "code"),
    # its matches come from operators.remote_loads, as names and files have to be followed
    Rule("DEPS-REMOTE-IMPORT", "critical", "dependencies", (*JS_ALL, *PY), (), "Remote URL import detected — code fetched from the network with no integrity check."),
    Rule("DEPS-INSTALL-SCRIPT-HOOKS", "high", "dependencies", ("package.json", "setup.py"), (r"\"(?:post|pre)install\"\s*:\s*\"[^\"]*\bnpm\s+(?:install|i|add)\b[^\"]*\"", r"\"(?:post|pre)install\"\s*:\s*\"[^\"]*\bpip3?\s+install\b[^\"]*\"", r"\"(?:post|pre)install\"\s*:\s*\"[^\"]*\b(?:curl|wget)\s+[^\"]*\"", r"subprocess\.\w+\(\s*\[?\s*['\"]pip['\"][^)]*\binstall\b[^)]*\)"), "Lifecycle install hook executes package installs — runs automatically and silently on npm install."),
    Rule("DEPS-TYPOSQUAT", "high", "dependencies", ("requirements.txt", "requirements*.txt", "package.json", "Pipfile", "pyproject.toml"), (rf"(?im)(?:^|['\",\s])({'|'.join(TYPOSQUATS)})(?:['\",\s>=<!@$]|$)",), "Known typosquatting package name detected."),
    Rule("DEPS-UNPINNED-SUSPECT", "medium", "dependencies", ("requirements.txt", "requirements*.txt", "Pipfile"), (r"(?m)^(?![#\s\[])([A-Za-z][A-Za-z0-9._-]+)\s*(?:>=|<=|!=|>|<|~=|$)",), "Dependency without exact version pin — may silently upgrade to a malicious release."),
    Rule("DEPS-INLINE-INSTALL", "medium", "dependencies", (*SCRIPTS, *MD), (r"\bpip3?[^\S\n]+install[^\S\n]+(?!-r\b)(?!--requirement\b)[A-Za-z0-9@]", r"\bnpm[^\S\n]+(?:install|i|add)[^\S\n]+[A-Za-z@]", r"\bconda[^\S\n]+install[^\S\n]+[A-Za-z]", r"\bsubprocess\.\w+\s*\(\s*\[\s*['\"](?:pip3?|npm|conda)['\"]\s*,\s*['\"](?:install|i|add)['\"]\s*,\s*['\"][A-Za-z0-9@]", r"\b(?:execFileSync|execFile|spawnSync|spawn)\s*\(\s*['\"](?:pip3?|npm|conda)['\"]\s*,\s*\[\s*['\"](?:install|i|add)['\"]\s*,\s*['\"][A-Za-z0-9@]"), "Inline package installation in skill code — installs packages at skill execution time."),
    Rule("FS-DESTRUCTIVE-HOME-DELETE", "critical", "filesystem", (*SH, "*.zsh", *PY, *JS, "*.cjs", *MD), (rf"(?im)(?:^|[;&|])[^\S\n]*(?:sudo\s+)?rm\s+{RM_FLAGS}\s+(?:--\s+)?(?<finding>(?:\"{RM_PATH}\"|'{RM_PATH}'|{RM_PATH}))(?=\s*(?:--no-preserve-root\b\s*)?(?:$|[;#&|]))", rf"\bshutil\.rmtree\s*\(\s*(?<finding>{PY_HOME})\s*(?=[,)])", r"\bfs(?:\.promises)?\.rm(?:Sync)?\s*\(\s*(?<finding>(?:os\.)?homedir\s*\(\s*\))\s*,[\s\S]{0,180}?\brecursive\s*:\s*true\b"), "Destructive delete targeting home, root, credential directories, or .git detected.", "deletes"),
    Rule("FS-CREDSTORE", "critical", "filesystem", (*SCRIPTS, *MD), (rf"{HOME}\.ssh/(id_[rd]sa|id_ecdsa|id_ed25519|authorized_keys)", rf"{HOME}\.aws/(credentials|config)", rf"{HOME}\.config/(gh/hosts\.yml|git/credentials)", rf"{HOME}\.(netrc|npmrc|pypirc|git-credentials)", rf"{HOME}\.(docker/config\.json|kube/config)", rf"{HOME}Library/Keychains/", r"/etc/(passwd|shadow)"), "Access to a known credential store path detected.", "docs"),
    Rule("FS-BROWSER-CREDENTIALSTORE", "critical", "filesystem", (*SCRIPTS, *MD), (rf"{HOME}(?:Library/Application Support/(?:Google/Chrome|Chromium)|\.config/(?:google-chrome|chromium))/(?:(?:Default|Profile [0-9]+|Guest Profile)/(?:Login Data|(?:Network/)?Cookies)|Local State){STORE_END}", rf"{HOME}(?:Library/Application Support/Firefox/Profiles|\.mozilla/firefox)/[^/\s]+/(?:key4\.db|logins\.json|cookies\.sqlite){STORE_END}", rf"{HOME}Library/(?:Cookies/Cookies\.binarycookies|Containers/com\.apple\.Safari/Data/Library/(?:Cookies/Cookies\.binarycookies|Safari/LocalStorage)|Safari/LocalStorage){STORE_END}"), "Access to a browser credential or cookie store path detected.", "taught"),
    Rule("FS-KEYCHAIN-ACCESS", "critical", "filesystem", SCRIPTS, (r"\bsecurity\s+find-(?:generic|internet)-password\b", r"\bkeyring\.get_password\s*\(", r"\bkeytar\.getPassword\s*\("), "Programmatic access to macOS Keychain or system credential store detected.", "taught"),
    Rule("FS-DOTENV-READ", "high", "filesystem", SCRIPTS, (r"\bload_dotenv\s*\(", r"open\s*\(\s*['\"]\s*\.env['\"]", r"readFileSync\s*\(\s*['\"]\s*\.env['\"]", r"\bcat\s+\.env\b", r"require\s*\(\s*['\"]dotenv['\"]\s*\)\.config\s*\("), "Explicit .env file read — skill may be harvesting project secrets.", "taught"),
    Rule("FS-BOUNDARY-ESCAPE", "high", "filesystem", SCRIPTS, (rf"\b(?:cat|less|more|head|tail|cp|mv|rm|chmod|chown)\b[^#\n]{{0,240}}{UP}", rf"\b(?:open|read_text|read_bytes|write_text|write_bytes)\s*\([^#\n]{{0,240}}{UP}", rf"\b(?:readFile(?:Sync)?|writeFile(?:Sync)?|createReadStream|createWriteStream)\s*\([^#\n]{{0,240}}{UP}", r"/proc/(?:self|[0-9]+)/environ", r"/etc/sudoers"), "Path traversal or access to protected system path detected.", "docs"),
    Rule("GIT-CRED-READ", "high", "git-history", (*SCRIPTS, *MD), (r"\bgit\s+credential\s+fill\b", r"\bgit\s+credential\s+approve\b", r"\bgit\s+config\b[^\n]{0,60}credential\.helper\b"), "Git credential subsystem access detected — may extract stored credentials.", "taught"),
    Rule("GIT-HISTORY-SCAN", "medium", "git-history", (*SCRIPTS, *MD), (r"\bgit\s+log\b[^\n]{0,80}-p\b[^\n]*\|[^\n]*\bgrep\b", r"\bgit\s+rev-list\s+--all\b[^\n]{0,80}\|\s*xargs\b", r"\bgit\s+log\b[^\n]{0,60}--all\b[^\n]*\|\s*grep\b", r"\bgit\s+grep\b[^\n]{0,60}--all-objects\b"), "Git history scanning detected — may uncover secrets from past commits.", "taught"),
    Rule("NET-CLOUD-METADATA-CREDENTIALS", "critical", "network-exfil", SCRIPTS, (rf"(?i)\b(?:requests|httpx)\.\w+\s*\([\s\S]{{0,300}}{METADATA}", rf"(?i)\bfetch\s*\([\s\S]{{0,300}}{METADATA}", rf"(?i)\b(?:curl|wget)\b[\s\S]{{0,300}}{METADATA}", rf"(?i)\b(?:os\.environ(?:\.get)?\s*\(\s*['\"](?:{CONTAINER})['\"]|process\.env(?:\.(?:{CONTAINER})|\s*\[\s*['\"](?:{CONTAINER})['\"]\s*\]))", r"(?i)\b(?:requests|httpx)\.\w+\s*\([\s\S]{0,200}https?://169\.254\.170\.2/"), "Cloud credential metadata endpoint access detected — may expose instance or container credentials.", "docs"),
    Rule("NET-OUTBOUND-NONLOCAL", "high", "network-exfil", SCRIPTS, (rf"\b(?:curl|wget)\s[^\n]{{0,200}}{ELSEWHERE}", rf"\b(?:requests|httpx)\.\w+\s*\(\s*['\"]{ELSEWHERE}", rf"\bfetch\s*\(\s*['\"]{ELSEWHERE}"), "Hardcoded outbound HTTP call to non-localhost address detected.", "outbound"),
    Rule("NET-WEBHOOK-KNOWN", "critical", "network-exfil", (*SCRIPTS, *MD), (r"https://discord\.com/api/webhooks/", r"https://hooks\.slack\.com/services/", r"https://api\.telegram\.org/bot[A-Za-z0-9_-]+/", r"https://ntfy\.sh/", r"https://discord\.com/api/channels/[0-9]+/messages", rf"(?i)https?://(?!(?:www|docs|app)\.)[\w.{{}}$-]+\.{CATCHERS}(?![\w.-])", r"(?i)https?://(?:webhook\.site|requestbin\.(?:net|com)|requestb\.in|hookb\.in)/(?:[\w{$-]|[\"'`]\s*\+)", r"(?i)https?://pastebin\.com/api/api_post\.php"), "Known webhook endpoint detected — data may be silently exfiltrated to an attacker-controlled channel.", "taught"),
    Rule("NET-RAW-SOCKET", "medium", "network-exfil", ("*.py", "*.sh", "*.js", "*.ts", "*.mjs"), (r"\bsocket\.socket\s*\(", r"\bsocket\s*\.\s*connect\s*\(\s*\(", r"\bnet\.createConnection\s*\(", r"\bnet\.connect\s*\("), "Raw socket creation detected — may be used for covert C2 communication.", "docs"),
    Rule("NET-DNS-UNUSUAL-TLD", "medium", "network-exfil", (*SCRIPTS, *MD), (rf"(?i)https?://[a-zA-Z0-9.-]+{ODD_TLD}", rf"(?i)(?:socket\.getaddrinfo|dns\.lookup|dns\.resolve)\s*\([^)]{{0,100}}{ODD_TLD}"), "Network connection to a TLD commonly used for C2 infrastructure.", "docs"),
    Rule("OBFS-BASE64-LARGE", "high", "obfuscation", TEXTS, (r"[A-Za-z0-9+/]{200,}={0,2}",), "Large base64 literal detected — possible obfuscated payload.", "taught"),
    Rule("OBFS-HEX-LARGE", "high", "obfuscation", TEXTS, (r"(?:0x)?[0-9a-fA-F]{400,}",), "Large hex literal detected — possible obfuscated shellcode or binary payload.", "taught"),
    Rule("OBFS-EVAL-ATOB", "critical", "obfuscation", (*JS_ALL, "*.py", "*.sh", "*.md"), (r"\beval\s*\(\s*atob\s*\(", r"\bexec\s*\(\s*base64\b[^)]*\.b64decode\s*\(", r"\beval\s*\(\s*Buffer\.from\s*\([^)]+,\s*['\"]base64['\"]\)"), "eval(atob(...)) or exec(base64.b64decode(...)) — executing base64-decoded payload.", "decoded"),
    Rule("OBFS-DECODE-EXEC", "critical", "obfuscation", DECODERS, (rf"(?i)\bbase64\b(?=[^\n|&;]{{0,160}}\s(?:-[A-Za-z]*d[A-Za-z]*|--decode)\b)[^\n|&;]{{0,220}}{SHELLS}", rf"(?i)\bopenssl\s+enc\b(?=[^\n|&;]{{0,180}}\s-d\b)(?=[^\n|&;]{{0,180}}\s-base64\b)[^\n|&;]{{0,240}}{SHELLS}", r"(?im)(?:^|[;&|(:=-]\s*)(?:[&.]\s*)?(?:powershell(?:\.exe)?|pwsh(?:\.exe)?)[^\n#\"'`]{0,200}-(?:EncodedCommand|enc|e)\b", r"(?i)\b(?:IEX|Invoke-Expression)\b\s*[\s(]{0,20}[^\n#]{0,240}\b(?:iwr|Invoke-WebRequest|DownloadString)\b", r"(?i)\b(?:iwr|Invoke-WebRequest|DownloadString)\b[^\n#|]{0,240}\|\s*(?:IEX|Invoke-Expression)\b"), "Decode-and-execute pattern detected — obfuscated payload execution.", "decoded"),
    Rule("OBFS-STRING-CONCAT-CMD", "medium", "obfuscation", (*JS, "*.cjs", "*.py", "*.sh", "*.md"), (r"(?i)[\"'](?:ba|cu|rm|wg|py|nc|ch|sc|dd|mk)[\"']\s*\+\s*[\"']", r"(?i)(?:\\x62\\x61\\x73\\x68|\\x63\\x75\\x72\\x6c|\\x77\\x67\\x65\\x74|\\x70\\x79\\x74\\x68\\x6f\\x6e|\\x72\\x6d\\x20\\x2d\\x72\\x66|\\x73\\x68\\x20\\x2d\\x63|\\x63\\x68\\x6d\\x6f\\x64)"), "String concatenation or hex escapes constructing shell command fragments.", "taught"),
    Rule("OBFS-HOMOGLYPH", "low", "obfuscation", TEXTS, (rf"(?<!{RUN})(?<finding>\b{RUN}*+{LOOKALIKE}{RUN}+|{RUN}++{LOOKALIKE}{RUN}*\b)", rf"(?<!{RUN})[.:/-]++(?<finding>\b{RUN}*+{LOOKALIKE}{RUN}+)", r"(?iu)(?<finding>\b(?:ignοre|οverride|bypαss|disαble|nοde|pythοn|cοm)[A-Za-z0-9_.:/-]*\b|https?://[^\s\"'`<>]*[αουν][^\s\"'`<>]*)"), "Homoglyph character detected — Unicode lookalike for an ASCII letter."),
    Rule("PI-OVERRIDE", "critical", "prompt-injection", PROMPTS, (r"(?i)(?<![\"'`])\bignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|rules?|prompts?)\b", r"(?i)(?<![\"'`])\bdisregard\s+(all\s+)?(previous|above|prior)\s+(context|instructions?|rules?|prompts?)?\b", r"(?i)\byou\s+are\s+now\s+(?:a\s+|an\s+)?(?:unrestricted|uncensored|unfiltered|unlimited|rule-?free|policy-?free|jailbroken|developer\s+mode)\b", r"(?i)\b(?:assume|adopt|switch\s+to|enter|take\s+on)\s+(?:a\s+|an\s+)?new\s+(role|identity|persona|system\s+prompt)\b(?=[\s\S]{0,120}\b(?:ignore|disregard|override|bypass|forget|replace|instead|previous|prior|above|system|developer)\b)", r"(?i)\bforget\s+(everything|your\s+instructions?)\b"), "Instruction-override phrasing detected.", "prompts"),
    Rule("PI-JAILBREAK", "high", "prompt-injection", PROMPTS, (r"(?i)\b(?:enable|activate|enter|use|switch\s+to)\s+DAN\s+mode\b|\b(?:act|pretend|roleplay)\s+as\s+DAN\b|\byou\s+are\s+DAN\b", r"(?i)\b(?:chatgpt|assistant|model)\s+developer\s+mode\b|\bdeveloper\s+mode\b(?=[\s\S]{0,100}\b(?:ignore|bypass|unfiltered|unrestricted|uncensored|no\s+(?:restrictions?|rules?|safety\s+guidelines?|safeguards?|limitations?)|can\s+do\s+anything)\b)", r"(?i)\b(?:use|run|apply|execute|follow)\s+(?:this\s+)?jailbreak\b|\bjailbreak\s+(?:the\s+)?(?:assistant|agent|model|chatgpt)\b|\bjailbreak\s+prompt\s*[:=]\s*[\"'`]", r"(?i)\b(?:act|operate|respond|roleplay|behave|answer)\s+(?:as\s+if\s+)?(?:you\s+(?:have|had|are\s+under)\s+)?(?:with\s+)?no\s+(restrictions?|rules?|safety\s+guidelines?|safeguards?|limitations?)\b", r"(?i)\bact\s+as\s+if\s+you\s+(have|had)\s+no\s+(restrictions?|rules?|limits?|guidelines?|safeguards?)\b"), "Jailbreak or bypass phrasing detected.", "prompts"),
    Rule("PI-HIDDEN-UNICODE", "critical", "prompt-injection", (*PROMPTS, "*.txt"), (r"[\x{200B}\x{200C}\x{200E}\x{200F}]", rf"(?<![{EMOJI}]\x{{FE0F}}?|[{characters(MODIFIER_BASES)}][\x{{1F3FB}}-\x{{1F3FF}}]|{KEYCAP})\x{{200D}}|\x{{200D}}(?![{EMOJI}]|{KEYCAP})", r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", r"[\x{2060}-\x{2064}]", r"[\x{FE00}-\x{FE0D}\x{E0100}-\x{E01EF}]", rf"(?<![{EMOJI}#*0-9])[\x{{FE0E}}\x{{FE0F}}]|(?<=[#*0-9])(?!\x{{FE0F}}\x{{20E3}})[\x{{FE0E}}\x{{FE0F}}]", r"(?<!^)\x{FEFF}", r"[\x{E0020}-\x{E007F}]"), "Invisible or bidi-control unicode character detected — may smuggle hidden instructions.", "prompts"),
    Rule("PI-HIDDEN-HTML-COMMENT", "medium", "prompt-injection", PAGES, (r"(?i)<!--[\s\S]{0,500}?\b(?:ignore|disregard|override|bypass|forget)\s+(?:all\s+)?(?:previous|prior|above|system|developer)?\s*(?:instructions?|rules?|prompts?|context|guidelines?)\b[\s\S]{0,500}?-->", r"(?i)<!--[\s\S]{0,500}?\b(?:pretend|act)\s+as\s+(?:if\s+)?(?:you|the\s+(?:assistant|model|agent))\s+(?:are|have|can)\b[\s\S]{0,500}?-->", r"(?i)<!--[\s\S]{0,500}?\b(?:you|assistant|model|agent)\s+(?:must|should|shall|always|never|will)\s+(?:ignore|disregard|override|bypass|forget|follow|obey|reveal|disclose|mention|tell|show|include|append|send|leak|exfiltrate|execute|run|respond)\b[\s\S]{0,500}?-->", r"(?i)<!--[\s\S]{0,500}?\b(?:always|never|must|shall)\s+(?:follow|obey)\s+(?:these|the|this)\s+(?:hidden\s+)?(?:instructions?|comment|directive)\b[\s\S]{0,500}?-->"), "HTML comment containing instruction-like directives detected.", "prompts"),
    Rule("PI-WHITE-ON-WHITE", "medium", "prompt-injection", PAGES, (rf"(?i)<(?:span|div|p)[^>]*style\s*=\s*[\"'][^\"']*{HIDDEN_STYLE}[^\"']*[\"'][^>]*>[\s\S]{{0,500}}{HIDDEN_ORDER}[\s\S]{{0,500}}</(?:span|div|p)>", r"(?i)style\s*=\s*[\"'][^\"']*color\s*:\s*(?:white|#fff{1,3})[^\"']*background(?:-color)?\s*:\s*(?:white|#fff{1,3})[^\"']*[\"'][^>]*>[\s\S]{0,500}\b(?:ignore|disregard|override|bypass|forget|follow|obey|send|leak|exfiltrate)\b[\s\S]{0,120}\b(?:instructions?|rules?|prompts?|system|secret|token|credential)\b"), "Invisible/white-on-white CSS styling detected — may hide injected instructions.", "prompts"),
    Rule("PI-METADATA-MISMATCH", "medium", "prompt-injection", ("SKILL.md", "AGENTS.md"), (rf"(?is)^---[\s\S]*?(?:name|description)\s*:[\s\S]*?---[\s\S]*?(?<finding>\b(?:(?:don['`]?t|do\s+not|never)\s+(?:tell|mention|reveal|disclose|show|share|say)\s+(?:(?:the\s+)?user\s+(?:about\s+)?)?{CONCEALED}|keep\s+{CONCEALED}\s+(?:hidden|confidential|secret)(?:\s+from\s+(?:the\s+)?user)?|(?:hide|conceal)\s+{CONCEALED}(?:\s+from\s+(?:the\s+)?user)?)\b)",), "Skill metadata present but body contains secrecy/concealment instructions — possible metadata mismatch attack.", "prompts"),
    Rule("PI-EXFIL-TRIGGER-CLAUSE", "critical", "prompt-injection", PROMPTS, (r"(?is)(when|whenever|if)\s+(?:the\s+)?user\s+(asks?|requests?|says?|opens?)[\s\S]{0,200}?(also|additionally|and)\s+(include|append|attach|send|post|write)[\s\S]{0,80}?(\$[A-Z_]{3,}|api[_\s\-]?key|token|secret|credential|process\.env|os\.environ|\.ssh|\.aws)", rf"(?i){NOT_QUOTED}{ON_REQUEST}{WITHIN}{{0,200}}?{ASIDE}{SENDS}", rf"(?i){NOT_QUOTED}{EACH_TIME}{WITHIN}{{0,200}}?{SENDS}"), "Trigger-clause exfiltration pattern detected: a conditional instruction leaks secrets or local context.", "prompts"),
    Rule("PI-PRIV-ESCALATE-INSTRUCTION", "high", "prompt-injection", PROMPTS, (r"(?im)(?:^|[\n.!?:;-]\s*|[-*]\s+)(?<finding>(?:(?:you|agent|assistant|skill|tool|script|command|process)\s+(?:must|should|can|may|needs?\s+to|will|shall)\s+)?(?:escalate|elevate)\s+(?:your|its|the\s+agent'?s)\s+(?:privileges?|access|permissions?)\b)", r"(?im)(?:^|[\n.!?:;-]\s*|[-*]\s+)(?<finding>(?:use\s+\w+\s+to\s+|try\s+to\s+|attempt\s+to\s+|always\s+|must\s+|you\s+must\s+)?gain\s+(?:root|admin(?:istrator)?|superuser)\s+access\b)", r"(?i)\buse\s+sudo\s+to\s+(read|write|access|get|fetch|steal|copy)\b", r"(?i)\bbypass\s+(?:file\s+)?(?:permissions?|access\s+controls?|security\s+checks?)\s+to\s+(?:read|write|access|get|fetch|steal|copy|modify|delete)\b", r"(?i)(?<!never\s)(?<!don't\s)(?<!do not\s)\brun\s+(?:this\s+)?(?:script\s+)?(?:with|as)\s+root\s*(?:privileges?|access|permissions?)?\b"), "Privilege-escalation instruction detected.", "prompts"),
    Rule("SKILL-CURL-BASH-IN-MD", "critical", "skill-specific", SKILLS_AND_CODE, (r"\b(curl|wget|fetch)\s[^|&;\n]{0,80}(?:(?<quote>[\"'])https?://[^\s\"']+\k<quote>|(?<![\"'])https?://[^\s\"'|]+)(\s[^|&;\n]{0,80})?(\||&&)\s*(sudo\s[-A-Za-z \t]{0,20})?(/[\w./-]{0,40}/)?(bash|sh|zsh|python3?(?!\s+-[cm]\b)|node(?!\s+-[ep]\b))\b", r"source\s*<\(\s*(curl|wget)\s+\S+\s*\)", r"eval\s*[\"'`]?\$\(\s*(curl|wget)"), "Pipe-to-shell via curl/wget detected — remote code execution vector.", "taught"),
    Rule("SKILL-FETCH-AND-EXEC", "critical", "skill-specific", SKILLS_AND_CODE, (r"fetch\s*\([^)]+\)\s*\.then\s*\([^)]*\beval\s*\(", r"\bexec\s*\(\s*(?:__import__\s*\(\s*['\"]requests['\"]\s*\)|requests)\s*\.\s*(?:get|post)\s*\([^)]+\)\s*\.\s*text", r"\bexec\s*\(\s*(?:urllib\.|urlopen\s*\()", r"eval\s*\(\s*await\s+(?:resp|response|res|r|data)\s*\.\s*text\s*\(\s*\)"), "Remote fetch result passed directly to eval/exec — arbitrary remote code execution.", "taught"),
    Rule("SKILL-DISABLE-SAFETY", "critical", "skill-specific", SKILLS, (r"(?i)\bdisable\s+(?:safe\s+mode|safety(?:\s+checks?)?|content\s+filter(?:ing)?|safety\s+filter(?:ing)?)\b", r"(?i)\bbypass\s+(?:safety(?:\s+checks?)?|content\s+polic(?:y|ies)|content\s+filter(?:ing)?|safeguards?)\b", r"(?i)\bignore\s+(?:content\s+polic(?:y|ies)|safety\s+guidelines?|content\s+filter(?:ing)?)\b", r"(?i)\bturn\s+off\s+(?:safety(?:\s+checks?)?|safe\s+mode|content\s+filter(?:ing)?)\b"), "Instruction to disable or bypass LLM safety controls detected.", "prompts"),
    Rule("SKILL-PASSWORD-ZIP", "critical", "skill-specific", SKILLS_AND_CODE, (r"unzip\s+-P\s+[\"']?\S+[\"']?\s+\S+\.zip", r"7z\s+x\s+-p\S+\s+\S+", r"\bunzip[ \t]+-P[ \t]*(?:[\"'](?![\s\"'$%{<`])|[^\s\"'$%{<`])", r"[Zz](?<![\w.-][Zz])[Ii][Pp](?=[ \t])[^\n|;&]{0,200}[ \t](?:-[A-Za-z0-9]{0,8}[Pe]|--(?:password|encrypt)\b)", r"(?i)zipcloak(?<![\w.-]zipcloak)[ \t]+(?:[-\"'$]|[^\s|;&]{0,200}\.zip\b)", r"(?i)(?<![\w.-])(?:7z[az]?|rar)[ \t]+a(?=[ \t])[^\n|;&]{0,200}[ \t]-h?p(?!-)\S", rf"{called('[Zz][Ii][Pp]')}[^\])}};]{{0,200}}[\"'`]{ZIP_FLAG}", rf"(?i){called('7z[az]?|rar')}[^\])}};]{{0,40}}[\"'`]a[\"'`][^\])}};]{{0,200}}[\"'`]-h?p(?!-)(?:[^\s\"'`]|[\"'`][ \t]{{0,4}}\+)", rf"(?i){called('zipcloak', IN_LIST)}[ \t]*,|{called('zipcloak', IN_CALL)}[ \t]*,[ \t\r\n]*[\[\"']", r"\bWZ_AES\b", r"[\"']zip-encrypted[\"']"), "Password-protected archive extraction or creation detected.", "taught"),
    Rule("SKILL-MEMORY-WRITE", "high", "skill-specific", SKILLS_AND_CODE, (rf"(?:^|\n){NOT_FORBIDDEN}[^#\n]*(?<finding>(?:{WRITES}[^#\n]*{AGENT_FILES}|{AGENT_FILES}[^#\n]*\b(?:[Ww]rite|[Aa]ppend)\b))", rf"(?:^|\n){NOT_FORBIDDEN}[^#\n]*(?<finding>(?:{FILE_WRITES}))"), "Writing to agent memory or config directory detected — potential persistent context poisoning.", "taught"),
    Rule("MCP-CONFIG-REMOTE-EXEC", "critical", "dependencies", (".mcp.json", "mcp.json", "settings.json", "settings.local.json", "hooks.json", "config.toml", "gemini-extension.json", "*.toml"), (rf"(?i){STARTUP}(?:curl|wget|fetch)\b[^\n|&;]{{0,240}}https?://[^\s\"'`)]+[^\n|&;]{{0,80}}\s*(?:\||&&)\s*(?:bash|sh|zsh|python|node)\b", rf"(?i){STARTUP}\bsource\s*<\(\s*(?:curl|wget)\b[^)]*https?://[^)]*\)", rf"(?i){STARTUP}\beval\s*(?:[\"'`]+\s*)?\$\(\s*(?:curl|wget)\b[^)]*https?://", rf"(?i){STARTUP}\b(?:bash|sh|zsh|python|node)\s+-c\s+[^\n]{{0,80}}\$\(\s*(?:curl|wget)\b[^)]*https?://", rf"(?i){STARTUP}[\"']-c[\"'](?:\s{{0,80}},(?:\s{{0,80}}(?:#|//)[^\n]{{0,200}}\n)?\s{{0,80}}[\"'])?[^\n]{{0,120}}\$\(\s*(?:curl|wget)\b[^)]*https?://"), "MCP or agent config startup command downloads and executes remote content.", "startup"),
    Rule("MCP-PROJECT-AUTO-APPROVE", "high", "dependencies", ("settings.json",), (r"\"enableAllProjectMcpServers\"\s*:\s*true\b", r"\"enabledMcpjsonServers\"\s*:\s*\[\s*\""), "Project settings auto-approve project MCP servers - they start without the consent prompt.", "settings", ("project",)),
    Rule("NET-API-ENDPOINT-OVERRIDE", "critical", "network-exfil", SETTINGS, (rf"(?i)\"(?:ANTHROPIC_(?:BEDROCK_|BEDROCK_MANTLE_|VERTEX_|FOUNDRY_|AWS_)?BASE_URL|OPENAI_BASE_URL)\"\s*:\s*\"\s*(?!https://(?:{OFFICIAL})(?::\d+)?[\"/])[^\"\s]",), "Project settings redirect the model API - the agent sends its API key and prompts to a non-official endpoint.", "settings", ("project",)),
    Rule("NET-HOOK-HTTP-EXTERNAL", "high", "network-exfil", (*SETTINGS, "hooks.json"), (r"\S+",), "Project HTTP hook posts session data to an external host - the repository author receives prompts, tool input and output, and any environment variables in its headers.", "hooks", ("project",), ("critical", "hooks_with_environment")),
    Rule("SEC-PROJECT-CREDENTIAL-HELPER", "high", "secrets", SETTINGS, (r"\"(?:apiKeyHelper|awsAuthRefresh|awsCredentialExport|gcpAuthRefresh)\"\s*:\s*\"\s*[^\"\s]",), "Project settings set a credential helper.", "settings", ("project",)),
    # keys of providers, and names of keys that are given a value with a long run of letters and digits; these shapes are our own
    Rule("SEC-HARDCODED-KEY", "critical", "secrets", (*SCRIPTS, "*.cjs", "*.jsx", "*.tsx", "*.json", ".env"), (r"\bsk-(?:ant-)?[A-Za-z0-9_-]{20,}", r"\bgh[po]_[A-Za-z0-9]{36}\b", r"\bAKIA[A-Z0-9]{16}\b", r"(?i)\b[a-z0-9_]*(?:key|token|secret)[\"']?\s*[:=]\s*[\"'][^\"'\s]{0,40}?(?<![a-z0-9])(?!([a-z0-9])\1{7})[a-z0-9+/]{24}"), "Hardcoded key or token detected."),
    # the forms of shell code; what a program reads and sends by way of names is not followed
    Rule("NET-EXFIL-ENV", "critical", "network-exfil", SCRIPTS, (rf"\b(?:curl|wget)\b(?:[^#\n]|\\\r?\n){{0,200}}\s{DATA_FLAG}(?:\s+|=)?[^\s\"']{{0,40}}(?:\"(?:[^\"\\\n]|\\.){{0,200}})?{DUMP_SUBSTITUTION}", rf"(?<![\w.$-]){ENV_DUMP}\s*\|(?!\|)(?:{STAGE}{{0,80}}\|){{0,3}}\s*(?:curl\b{STAGE}{{0,200}}(?:@|\s(?:-[A-Za-z]*T|--upload-file)\s*){STDIN}|wget\b{STAGE}{{0,200}}--(?:post|body)-file[=\s][\"']?{STDIN}|(?:nc|ncat|netcat)\s)", rf"\b(?:curl|wget|nc|ncat|netcat)\b{STAGE}{{0,200}}(?:<<<\s*\"?|<\s*){DUMP_SUBSTITUTION}"), "Environment variables transmitted over outbound HTTP — credential exfiltration.", "dumps"),
)

# fixed values: rules that force a verdict alone, and the parts of compound triggers
FAIL_ALONE = ("NET-EXFIL-ENV", "NET-WEBHOOK-KNOWN", "SKILL-PASSWORD-ZIP", "PI-EXFIL-TRIGGER-CLAUSE", "OBFS-EVAL-ATOB")
PIPE_RULES = ("SKILL-CURL-BASH-IN-MD", "SKILL-FETCH-AND-EXEC", "CODEEXEC-JS-CHILDPROCESS-SHELL", "CODEEXEC-SHELL-BACKTICK")
STORE_RULES = ("FS-CREDSTORE", "FS-BROWSER-CREDENTIALSTORE", "FS-KEYCHAIN-ACCESS")
SAME_LINE = (
    ("PI-JAILBREAK", "FS-CREDSTORE"),
    ("PI-JAILBREAK", "FS-BROWSER-CREDENTIALSTORE"),
    ("PI-JAILBREAK", "FS-KEYCHAIN-ACCESS"),
    ("PI-PRIV-ESCALATE-INSTRUCTION", "FS-BROWSER-CREDENTIALSTORE"),
    ("PI-PRIV-ESCALATE-INSTRUCTION", "FS-KEYCHAIN-ACCESS"),
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
PENALTIES = {"critical": 25, "high": 10, "medium": 3, "low": 1}

