"""Hosts of link shorteners, by their last label. Another list, one host a line with `#` comments, can be read with `read`."""

from __future__ import annotations

_HOSTS = {
    "com": "xr 2ya 4sq 6url azqq digg fexr url9 yiyd yweb abbrr adjix bitly doiop eweri fhurl mjobx piurl poprl shmyl shorl snipr snurl spedr urlao urlot voomr xaddr yatuc yfrog 301url alturl budurl canurl digbig elfurl esyurl flingk go2cut memurl moourl on.wsj qicute redirx shrten simurl sturly thnlnk tweetl ulimit urlbee urlcut urltea urlzen vzturl weturl xeeurl zootit burnurl cuturls easyuri get-url hosturl icanhaz jobsurl kindurl krunchd nanoref notlong plumurl rubyurl shortio shrinkr snipurl tiniuri tiny123 tinyurl tubeurl urlborg urlhawk vdirect dwarfurl lookleap minilien quip-art shorturl shrunkin starturl tighturl traceurl truncurl u.mavrev urlcover webalias zipmyurl decenturl linkslice notifyurl oboeyasui sharetabs shrinkify urlcutter clickmeter shortenurl shrink2one shrinkster twitterpan hotredirect makeitbrief netshortcut nutshellurl shorterlink sitelutions tweetburner link.toolbot makeashorterlink",
    "ly": "t ht om ow ru to adf bit owl buff cutt post snip rebrand",
    "me": "fb wp b2l go2 pnt shw dfl8 hurl bloat migre mnstr on.fb plurl url360",
    "net": "23o ne1 idek jmp2 ln-s qlnk shim shurl iscool easyurl liteurl paulding",
    "in": "c-o lnk xil ilix lnkd nsfw 1link myurl",
    "to": "u amzn beam ebay fire huff short profile",
    "us": "b65 s7y xrl durl parv turo faceto shrinkurl",
    "gd": "v is tl lnk riz soo",
    "it": "yep dlvr hurl kutt sqrl chilp",
    "io": "hex t2m zpr short tinyvid",
    "org": "u76 w3t tnij urlx muhlink",
    "uk": "url.co wapurl.co quickurl.co shortlinks.co shorterlink.co",
    "de": "u6e urlenco firsturl shorturl",
    "im": "ff sn tr p.ost",
    "ws": "fly2 hurl sgoti tinyarro",
    "at": "2big twirl shorturl",
    "cc": "4url tiny twurl",
    "ch": "tcrn gowat linkbun",
    "co": "t x hyperurl",
    "eu": "a2n ezurl smarturl",
    "st": "po shrt shorte",
    "am": "kl pd",
    "as": "cort just",
    "be": "kissa youtu",
    "ca": "ur1 tinyuri",
    "gs": "cli fon",
    "ie": "url short",
    "ms": "nyti twittu",
    "ag": "cot",
    "al": "trib",
    "bg": "bloom",
    "bz": "opn",
    "cm": "short",
    "coop": "s",
    "cr": "lin",
    "do": "bit",
    "ee": "mcaf",
    "es": "shar",
    "fi": "dy",
    "fm": "ping",
    "fr": "minurl",
    "gg": "gg",
    "gl": "goo",
    "gy": "rb",
    "hn": "bull",
    "ink": "bl",
    "kr": "flic",
    "lt": "ix",
    "ma": "zi",
    "mn": "safe",
    "mp": "j",
    "nf": "nn",
    "nl": "twurl",
    "nu": "u",
    "pl": "tiny",
    "pr": "su",
    "ru": "clck",
    "se": "x",
    "so": "kazi",
    "tt": "db",
}
BUILT_IN = tuple(sorted(f"{name}.{last}" for last, names in _HOSTS.items() for name in names.split()))


def read(lines: list[str]) -> tuple[str, ...]:
    return tuple(sorted({host for x in lines if (host := x.partition("#")[0].strip().lower())}))
