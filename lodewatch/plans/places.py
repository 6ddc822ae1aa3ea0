"""Where agents keep what they load, as data: fixed values, one row a place.

A root is "home", "project" (the working folder), "parents" (the working folder and those above up to the repository's root),
"inner parents" (the same, but below home), "above" (all folders above) or "plugin" (the folder of an active plugin).
"""

from __future__ import annotations

SKILL, HOOK = "SKILL.md", "HOOK.md"
# fixed values: agents that read the shared folder of skills, and folders that show that an agent is installed
SHARED_READERS = ("codex", "cursor", "copilot", "gemini", "windsurf", "cline", "opencode", "amp")
INSTALLED = (
    ("claude-code", "home", ".claude"), ("cursor", "home", ".cursor"), ("copilot", "home", ".copilot"), ("cline", "home", ".cline"), ("cline", "home", "Documents/Cline"), ("cline", "home", "Cline"),
    ("cline", "project", ".clinerules"), ("cline", "project", ".cline"), ("codex", "home", ".codex"), ("gemini", "home", ".gemini"), ("windsurf", "home", ".codeium/windsurf"), ("windsurf", "project", ".windsurf/rules"),
    ("opencode", "home", ".config/opencode"), ("opencode", "home", ".local/share/opencode"), ("amp", "home", ".config/amp"), ("openclaw", "home", ".openclaw"),
)
# fixed values: shared instruction files, and what is never loaded
SWEPT = ("AGENTS.md", "AGENTS.override.md", "AGENT.md", "CLAUDE.md", "GEMINI.md", ".cursorrules", ".windsurfrules", "CONVENTIONS.md")
NEVER = ("/.claude/plugins/.trash/", "/.claude/plugins/cache/", "/.cursor/plugins/cache/", "/.codex/plugins/.remote-plugin-install-staging/", "/.codex/plugins/.marketplace-plugin-source-staging/")

# fixed values: agent, root, glob, format, and the name that selects rules where it isn't the file's own
PLACES: tuple[tuple[str, str, str, str, str | None], ...] = (
    ("claude-code", "home", ".claude/skills/*/SKILL.md", SKILL, None),
    ("claude-code", "home", ".claude/plugins/**/SKILL.md", SKILL, None),
    ("claude-code", "home", ".claude/commands/**/*.md", SKILL, None),
    ("claude-code", "home", ".claude/agents/*.md", "agents-md", None),
    ("claude-code", "home", ".claude/settings.json", "agent-config", None),
    ("claude-code", "home", ".claude.json", "mcp-json", ".mcp.json"),
    ("claude-code", "home", ".claude/CLAUDE.md", "agents-md", None),
    ("claude-code", "home", ".claude/rules/**/*.md", "agents-md", None),
    ("claude-code", "plugin", "skills/**/SKILL.md", SKILL, None),
    ("claude-code", "plugin", "commands/**/*.md", SKILL, None),
    ("claude-code", "plugin", "agents/*.md", "agents-md", None),
    ("claude-code", "plugin", "hooks/hooks.json", "agent-config", None),
    ("claude-code", "plugin", ".mcp.json", "mcp-json", None),
    ("claude-code", "inner parents", ".claude/skills/*/SKILL.md", SKILL, None),
    ("claude-code", "inner parents", ".claude/commands/**/*.md", SKILL, None),
    ("claude-code", "inner parents", ".claude/agents/*.md", "agents-md", None),
    ("claude-code", "above", ".claude/CLAUDE.md", "agents-md", None),
    ("claude-code", "above", ".claude/AGENTS.md", "agents-md", None),
    ("claude-code", "above", "CLAUDE.local.md", "agents-md", None),
    ("claude-code", "above", ".claude/rules/**/*.md", "agents-md", None),
    ("claude-code", "project", ".claude/settings.json", "agent-config", None),
    ("claude-code", "project", ".claude/settings.local.json", "agent-config", None),
    ("claude-code", "project", ".mcp.json", "mcp-json", None),
    ("claude-code", "project", ".claude-plugin/plugin.json", "plugin.json", None),
    ("claude-code", "project", ".claude-plugin/marketplace.json", "plugin.json", None),
    ("cursor", "home", ".cursor/plugins/local/*/skills/*/SKILL.md", SKILL, None),
    ("cursor", "home", ".cursor/rules/*.mdc", "rules-md", None),
    ("cursor", "project", ".cursor/rules/*.mdc", "rules-md", None),
    ("cursor", "project", ".cursorrules", "rules-md", None),
    ("copilot", "home", ".copilot/copilot-instructions.md", "agents-md", None),
    ("copilot", "home", ".copilot/instructions/**/*.instructions.md", "agents-md", None),
    ("copilot", "home", ".copilot/agents/**/*.md", "agents-md", None),
    ("copilot", "home", ".copilot/skills/*/SKILL.md", SKILL, None),
    ("copilot", "home", ".claude/skills/*/SKILL.md", SKILL, None),
    ("copilot", "home", ".copilot/mcp-config.json", "mcp-json", ".mcp.json"),
    ("copilot", "home", ".copilot/hooks/*.json", "agent-config", "hooks.json"),
    ("copilot", "home", ".copilot/settings.json", "agent-config", None),
    ("copilot", "project", ".github/skills/*/SKILL.md", SKILL, None),
    ("copilot", "project", ".github/copilot-instructions.md", "agents-md", None),
    ("copilot", "project", ".github/instructions/**/*.instructions.md", "agents-md", None),
    ("copilot", "project", ".github/prompts/**/*.prompt.md", "prompt-md", None),
    ("copilot", "project", ".github/agents/**/*.md", "agents-md", None),
    ("copilot", "project", ".github/mcp.json", "mcp-json", ".mcp.json"),
    ("copilot", "project", ".vscode/mcp.json", "mcp-json", ".mcp.json"),
    ("copilot", "project", ".github/hooks/*.json", "agent-config", "hooks.json"),
    ("copilot", "project", ".github/copilot/settings.json", "agent-config", None),
    ("copilot", "project", ".github/copilot/settings.local.json", "agent-config", None),
    ("cline", "home", ".cline/skills/*/SKILL.md", SKILL, None),
    ("cline", "home", "Documents/Cline/Workflows/*.md", "prompt-md", None),
    ("cline", "home", ".cline/data/settings/cline_mcp_settings.json", "mcp-json", ".mcp.json"),
    ("cline", "project", ".clinerules", "rules-md", ".cursorrules"),
    ("cline", "project", ".cline/skills/*/SKILL.md", SKILL, None),
    ("cline", "project", ".clinerules/skills/*/SKILL.md", SKILL, None),
    ("cline", "project", ".clinerules/workflows/*.md", "prompt-md", None),
    ("codex", "home", ".codex/AGENTS.md", "agents-md", None),
    ("codex", "home", ".codex/AGENTS.override.md", "agents-md", None),
    ("codex", "home", ".codex/config.toml", "mcp-toml", None),
    ("codex", "home", ".codex/skills/**/SKILL.md", SKILL, None),
    ("codex", "home", ".codex/prompts/*.md", "prompt-md", None),
    ("codex", "home", ".codex/hooks.json", "agent-config", None),
    ("codex", "project", ".codex/config.toml", "mcp-toml", None),
    ("codex", "project", ".codex/hooks.json", "agent-config", None),
    ("windsurf", "home", ".codeium/windsurf/memories/global_rules.md", "rules-md", None),
    ("windsurf", "home", ".codeium/windsurf/hooks.json", "agent-config", None),
    ("windsurf", "home", ".codeium/hooks.json", "agent-config", None),
    ("windsurf", "parents", ".windsurf/rules/*.md", "rules-md", None),
    ("windsurf", "project", "**/.windsurf/rules/*.md", "rules-md", None),
    ("windsurf", "project", ".devin/hooks.json", "agent-config", None),
    ("windsurf", "project", ".windsurf/hooks.json", "agent-config", None),
    ("amp", "home", ".config/AGENTS.md", "agents-md", None),
    ("amp", "home", ".config/amp/AGENTS.md", "agents-md", None),
    ("amp", "home", ".config/amp/settings.json", "mcp-json", None),
    ("amp", "home", ".config/amp/settings.jsonc", "mcp-json", "settings.json"),
    ("amp", "home", ".config/amp/plugins/*.[jt]s", "agent-config", None),
    ("openclaw", "home", ".openclaw/openclaw.json", "mcp-json", ".mcp.json"),
    ("openclaw", "home", ".openclaw/skills/**/SKILL.md", SKILL, None),
    ("openclaw", "home", ".openclaw/agents/*/agent/workshop-skills/**/SKILL.md", SKILL, None),
    ("openclaw", "home", ".openclaw/hooks/*/HOOK.md", "agent-config", None),
    ("openclaw", "home", ".openclaw/workspace/skills/**/SKILL.md", SKILL, None),
    ("openclaw", "home", ".openclaw/workspace/.agents/skills/**/SKILL.md", SKILL, None),
    *(("openclaw", "home", f".openclaw/workspace/{name}.md", "agents-md", None) for name in ("AGENTS", "SOUL", "USER", "IDENTITY", "BOOT", "BOOTSTRAP", "MEMORY", "TOOLS", "HEARTBEAT")),
    ("openclaw", "home", ".agents/skills/**/SKILL.md", SKILL, None),
    # the same in several roots, folders or files
    *(("cursor", root, place, kind, name) for root in ("home", "project") for place, kind, name in ((".cursor/mcp.json", "mcp-json", None), (".cursor/hooks.json", "agent-config", None), (".cursor/skills/**/SKILL.md", SKILL, None), (".cursor/agents/**/*.md", "agents-md", None), (".cursor/agents/**/*.mdc", "agents-md", None))),
    *(("cline", root, f"{folder}/*.{end}", "rules-md", None) for root, folder in (("home", "Documents/Cline/Rules"), ("home", "Cline/Rules"), ("project", ".clinerules")) for end in ("md", "txt")),
    *(("gemini", root, place, kind, None) for root in ("home", "project") for place, kind in ((".gemini/extensions/**/gemini-extension.json", "gemini-extension-json"), (".gemini/commands/**/*.toml", "gemini-command-toml"), (".gemini/agents/**/*.md", "gemini-agent-md"), (".gemini/skills/**/SKILL.md", SKILL), (".gemini/settings.json", "agent-config"))),
    *(("opencode", root, f"{folder}/{place}", kind, None) for root, folder in (("home", ".config/opencode"), ("parents", ".opencode")) for place, kind in (("agents/**/*.md", "agents-md"), ("modes/**/*.md", "agents-md"), ("commands/**/*.md", "prompt-md"), ("skills/**/SKILL.md", SKILL), ("plugins/*.[jt]s", "agent-config"), ("AGENTS.md", "agents-md"), ("opencode.json", "mcp-json"))),
    *(("opencode", "parents", name, "mcp-json", None) for name in ("opencode.json", "opencode.jsonc")),
    *((agent, root, f"{folder}/skills/**/SKILL.md", SKILL, None) for agent in ("opencode", "amp") for root, folder in (("home", ".claude"), ("parents", ".claude"), ("parents", ".agents"))),
    *((agent, root, ".agents/skills/**/SKILL.md", SKILL, None) for agent in SHARED_READERS for root in ("home", "project")),
    *(("cross-agent", "parents", name, "agents-md", None) for name in SWEPT),
)
