"""Column roles (B1, B2): which column plays category, topic, date, metric...

Detection happens while the plan is built, from ``df.columns`` only; no data is
read.  Matching is case-insensitive and, as in the dashboard, the *last*
matching column wins a role.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Accepted column names per role, lower case, in detection order.
ROLE_SYNONYMS = {
    "level1": ("level1", "category", "l1", "cat"),
    "level2": ("level2", "subcategory", "l2", "subcat", "sub_category"),
    "topic": ("topic", "prompt", "query", "search_term"),
    "date": ("date", "datetime", "timestamp"),
    "conversations": ("raw_conversations", "conversations", "conv", "count"),
    "users": ("raw_users", "users", "user_count"),
    "messages": ("raw_messages", "messages", "msg_count"),
}
# Roles a caller may override; the dashboard's "None" choice means absent.
OVERRIDABLE = ("level1", "level2", "topic", "conversations")
NONE_CHOICE = "None"


@dataclass(frozen=True)
class Roles:
    level1: str | None = None
    level2: str | None = None
    topic: str | None = None
    date: str | None = None
    conversations: str | None = None
    users: str | None = None
    messages: str | None = None

    def as_dict(self) -> dict[str, str | None]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @property
    def metric(self) -> str | None:
        return self.conversations


def detect_roles(columns) -> Roles:
    found: dict[str, str] = {}
    for col in columns:
        low = col.lower()
        for role, names in ROLE_SYNONYMS.items():
            if low in names:
                found[role] = col
                break
    return Roles(**found)


def override_roles(roles: Roles, columns, **choices: str | None) -> Roles:
    """Replace detected roles; ``None`` or ``'None'`` removes one."""
    cols = set(columns)
    changes = {}
    for role, value in choices.items():
        if role == "metric":
            role = "conversations"
        if role not in OVERRIDABLE:
            raise ValueError(f"role {role!r} cannot be overridden (allowed: {OVERRIDABLE})")
        if value is None or value == NONE_CHOICE:
            changes[role] = None
        elif value not in cols:
            raise ValueError(f"no column {value!r}")
        else:
            changes[role] = value
    return replace(roles, **changes)


def present(roles: Roles, columns) -> Roles:
    """Drop roles whose column is not in ``columns``."""
    cols = set(columns)
    return Roles(**{k: (v if v in cols else None) for k, v in roles.as_dict().items()})
