"""Rule tables as data: (group, id, pattern). Patterns are Java regexes without regard to case."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    group: str
    id: str
    pattern: str
    words: tuple[str, ...] = ()  #: in lower case: every match has one of them as it stands; none if there is no such word


# Fixed values.
_COMPLETED = r"(?:построен|возвед[её]н|введ[её]н|сдан)\p{L}*"
_COMPLETED_WORDS = ("построен", "возвед", "введ", "сдан")
CONSTRUCTION = [
    Rule("construction", "vertical.construction.build", r"строительств\p{L}*", ("строительств",)),
    Rule("construction", "vertical.construction.installation", r"строительно-монтажн\p{L}*", ("строительно-монтажн",)),
    Rule("construction", "vertical.construction.reconstruction", r"реконструкц\p{L}*", ("реконструкц",)),
    Rule("construction", "vertical.construction.repair", r"капитальн\p{L}*\s+ремонт\p{L}*", ("капитальн",)),
    Rule("construction", "vertical.construction.contractor", r"подрядчик\p{L}*", ("подрядчик",)),
    Rule("construction", "vertical.construction.material", r"стройматериал\p{L}*", ("стройматериал",)),
]
HORECA = [
    # The word boundary is spelled out in ASCII: engines differ on what \b takes for a letter.
    Rule("horeca", "vertical.horeca.literal", r"(?<![A-Za-z0-9_])horeca(?![A-Za-z0-9_])", ("horeca",)),
    Rule("horeca", "vertical.horeca.restaurant", r"ресторан\p{L}*", ("ресторан",)),
    Rule("horeca", "vertical.horeca.hotel", r"(?:гостиниц|отел)\p{L}*", ("гостиниц", "отел",)),
    Rule("horeca", "vertical.horeca.seats", r"посадочн\p{L}*\s+мест\p{L}*", ("посадочн",)),
    Rule("horeca", "vertical.horeca.hospitality", r"гостеприимств\p{L}*", ("гостеприимств",)),
]
OPPORTUNITY = [
    Rule("opportunity", "opportunity.tender", r"тендер\p{L}*", ("тендер",)),
    Rule("opportunity", "opportunity.procurement", r"закуп\p{L}*", ("закуп",)),
    Rule("opportunity", "opportunity.applications", r"при[её]м\s+заявок", ("заявок",)),
    Rule("opportunity", "opportunity.supplier-selection", r"отбор\s+поставщик\p{L}*", ("поставщик",)),
    Rule("opportunity", "opportunity.contractor", r"подрядчик\p{L}*", ("подрядчик",)),
    Rule("opportunity", "opportunity.planned", r"запланирован\p{L}*", ("запланирован",)),
    Rule("opportunity", "opportunity.opening", r"(?:открыти|откро)\p{L}*", ("откры", "откро",)),
    Rule("opportunity", "opportunity.construction", r"строительств\p{L}*", ("строительств",)),
    Rule("opportunity", "opportunity.reconstruction", r"реконструкц\p{L}*", ("реконструкц",)),
    Rule("opportunity", "opportunity.budget", r"бюджет\p{L}*", ("бюджет",)),
]
ADVERTISEMENT = [
    Rule("advertisement", "advertisement.explicit", r"(?:^|[\s:])реклам\p{L}*", ("реклам",)),
    Rule("advertisement", "advertisement.discount", r"скидк\p{L}*", ("скидк",)),
    Rule("advertisement", "advertisement.promotion", r"акци\p{L}*", ("акци",)),
    Rule("advertisement", "advertisement.call-to-action", r"(?:оставьте\s+заявку|закажите\s+консультацию)", ("заявку", "консультацию",)),
]
IRRELEVANCE = [
    Rule("irrelevance", "irrelevance.no-commercial-opportunity", r"(?:закуп\p{L}*|тендер\p{L}*|construction|horeca)\s+не\s+заявлен\p{L}*", ("заявлен",)),
    Rule("irrelevance", "irrelevance.general-notice", r"информаци\p{L}*\s+общего\s+назначения", ("информаци",)),
]
RULES_V1 = CONSTRUCTION + HORECA + OPPORTUNITY + ADVERTISEMENT + IRRELEVANCE
RULES_V2 = (
    [*CONSTRUCTION, Rule("construction", "vertical.construction.completed-build", _COMPLETED, _COMPLETED_WORDS), *HORECA]
    + [*OPPORTUNITY, Rule("opportunity", "opportunity.completed-build", _COMPLETED, _COMPLETED_WORDS), *ADVERTISEMENT, *IRRELEVANCE]
)
