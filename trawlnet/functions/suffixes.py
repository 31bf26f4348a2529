"""A subset of the public suffixes: top-level domains, second-level ones in common use, and wildcards.

A larger list, one suffix a line with `*.` for wildcards, can be read with `read`.
"""

from __future__ import annotations

from dataclasses import dataclass

_COUNTRIES = "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg es et eu fi fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jo jp ke kg ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no nr nu nz om pa pe pf ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws yt za zm zw".split()
_GENERIC = "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx arpa app dev page blog shop store online site website tech space xyz top club cloud live news media agency company digital email group life link network press social solutions studio systems team today tools work world wiki zone academy art bank beer berlin bible bio build cafe camp care cash center chat church city coach codes community computer consulting cool design directory earth education energy engineering events exchange expert express farm finance fit foundation fun fund fyi gallery games garden global guide guru health help house how ink institute international jetzt kitchen land law lawyer legal ltd market marketing money movie museum ngo one ong paris party pet photo photos pics pizza place plus pub radio red rent report review rocks run sale school science services sh show soccer software solar style support surf tips town toys trade training tube university vacations video vip vision vote watch web wedding win wine yoga".split()
_SECOND = {
    "uk": "co org ac gov ltd plc me net nhs police sch", "jp": "co ne or ac ad ed go gr lg", "au": "com net org edu gov asn id", "nz": "co net org ac govt geek gen iwi maori school",
    "br": "com net org gov edu art blog eco ind inf", "in": "co net org ac edu gov res firm gen ind nic", "kr": "co ne or re pe go ac hs ms es", "za": "co net org ac gov edu law nom school web",
    "cn": "com net org gov edu ac mil", "tw": "com net org gov edu idv game club", "hk": "com net org gov edu idv", "sg": "com net org gov edu per", "my": "com net org gov edu name",
    "mx": "com net org gob edu", "ar": "com net org gob edu gov int mil tur", "tr": "com net org gov edu web gen bel k12 av", "il": "co net org ac gov muni k12 idf", "th": "co net or ac go in mi",
    "id": "co net or ac go web sch my", "ph": "com net org gov edu", "vn": "com net org gov edu", "pl": "com net org edu gov info waw", "ru": "ac edu gov int mil", "ua": "com net org gov edu in kiev kyiv lviv",
    "gr": "com net org gov edu", "pt": "com net org gov edu", "es": "com nom org gob edu", "fr": "asso com gouv nom prd tm", "it": "edu gov", "at": "ac co gv or", "hu": "co org info", "co": "com net org gov edu nom",
    "pe": "com net org gob edu nom", "ve": "co com net org gob edu info web", "ec": "com net org gob edu fin info", "uy": "com net org gub edu", "cl": "gob gov mil co", "eg": "com net org gov edu",
    "sa": "com net org gov edu med pub sch", "ae": "co net org ac gov sch mil", "pk": "com net org gov edu", "ke": "co or ac go me ne sc info", "ng": "com net org gov edu name", "lk": "com net org gov edu",
    "ir": "co net org ac gov sch id", "rs": "co org edu ac gov in",
}
_WILD = ("ck", "er", "fk", "jm", "kh", "mm", "np", "pg", "bd")


@dataclass(frozen=True)
class Suffixes:
    """tops: one label; seconds: two; wild: top-level ones below which any one label more is a suffix; longer: of three labels and more, and `*.` before two and more; exceptions: domains that a wildcard would take for suffixes."""

    tops: frozenset[str]
    seconds: frozenset[str]
    wild: frozenset[str]
    longer: frozenset[str] = frozenset()
    exceptions: frozenset[str] = frozenset()

    @classmethod
    def read(cls, lines: list[str]) -> Suffixes:
        """From lines of a suffix list: comments, plain suffixes, wildcards and exceptions."""
        names = [x.split()[0].lower() for x in lines if x.strip() and not x.startswith("//")]
        plain = {x for x in names if not x.startswith(("*.", "!"))}
        wild = {x[2:] for x in names if x.startswith("*.")}
        longer = {x for x in plain if x.count(".") > 1} | {f"*.{x}" for x in wild if "." in x}
        return cls(
            frozenset(x for x in plain | wild if "." not in x), frozenset(x for x in plain if x.count(".") == 1), frozenset(x for x in wild if "." not in x), frozenset(longer), frozenset(x[1:] for x in names if x.startswith("!"))
        )


BUILT_IN = Suffixes(frozenset([*_COUNTRIES, *_GENERIC, *_WILD]), frozenset(f"{a}.{top}" for top, seconds in _SECOND.items() for a in seconds.split()), frozenset(_WILD))
