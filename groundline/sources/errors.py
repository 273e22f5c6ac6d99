"""Typed refusals. Only malformed input is raised; the others are outcomes of the gates, explained here alike."""

from __future__ import annotations

MESSAGES = {
    "INSUFFICIENT_COVERAGE": "Clear pixels cover {coverage:.1%} of the yard; {required:.0%} are needed. Clouds hide the rest, so the site gets no temperature.",
    "NO_THERMAL_OVERLAP": "The yard lies outside the thermal scene, which therefore says nothing of its surface temperature.",
    "FIT_UNRELIABLE": "Cover explains too little of the temperature around this site (R² = {r2:.2f}). Cover and cost stand; no change of temperature is given.",
    "FIXTURE_MALFORMED": "{path} is not usable: {detail}",
}
REMEDIES = {
    "INSUFFICIENT_COVERAGE": "Choose a date with a clear sky.",
    "NO_THERMAL_OVERLAP": "Choose a scene that holds the yard, or check the yard's projection.",
    "FIT_UNRELIABLE": "Choose a scene with more contrast between bare and planted ground.",
    "FIXTURE_MALFORMED": "Write the file anew and compare its size with its header.",
}


def explained(code: str, **detail: object) -> str:
    return MESSAGES[code].format(**detail)


class Refusal(Exception):
    """An error with a code and the details that its message is made of."""

    def __init__(self, code: str, **detail: object):
        super().__init__(explained(code, **detail))
        self.code, self.detail, self.remedy = code, detail, REMEDIES[code]


class Malformed(Refusal):
    def __init__(self, path: str, detail: str):
        super().__init__("FIXTURE_MALFORMED", path=path, detail=detail)
