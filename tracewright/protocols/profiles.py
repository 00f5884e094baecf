"""Standard signal names of bus protocols, by profile and channel.

The AXI channels are built by rule: a channel's prefix before the names of its
fields, and most profiles as what a fuller one leaves after some fields go."""

from __future__ import annotations

#: Fields of the address channels in their fullest form, and what only one direction has.
_ADDRESS = (
    "id addr region len size burst lock cache prot nse pas inst priv qos user domain snoop stashnid stashniden stashlpid stashlpiden trace loop mmuvalid mmusecsid mmusid mmussidv mmussid mmuatst mmuflow "
    "mmupasunknown mmupm pbha mecid nsaid subsysid atop mpam chunken idunq cmo tagop act actv"
).split()
_WRITE_ONLY, _READ_ONLY = "stashnid stashniden stashlpid stashlpiden atop cmo".split(), ["chunken"]
_NEWEST, _MMU = "pas inst priv mmupasunknown mmupm act actv".split(), "mmuvalid mmusecsid mmusid mmussidv mmussid mmuatst mmuflow".split()
_CLASSIC = "id addr len size burst lock cache prot qos region user".split()
_ACE5 = "trace loop mmusecsid mmusid mmussidv mmussid mmuatst nsaid mpam idunq".split()


def _channel(prefix: str, fields: list[str] | str) -> list[str]:
    return [prefix + f for f in (fields.split() if isinstance(fields, str) else fields)]


def _pair(write: list[str], read: list[str]) -> tuple[list[str], list[str]]:
    return _channel("aw", write), _channel("ar", read)


def _less(fields: list[str], *gone: list[str]) -> list[str]:
    return [f for f in fields if not any(f in g for g in gone)]


def _axi() -> dict[str, tuple[str, dict[str, list[str]]]]:
    full_w, full_r = _less(_ADDRESS, _READ_ONLY), _less(_ADDRESS, _WRITE_ONLY)
    five = {"w": _channel("w", "data strb tag tagupdate last user poison trace"), "b": _channel("b", "id idunq resp comp persist tagmatch user trace loop busy"), "r": _channel("r", "id idunq data tag resp last user poison trace loop chunkv chunknum chunkstrb busy")}
    four = {"w": _channel("w", "data strb last user"), "b": _channel("b", "id resp user"), "r": _channel("r", "id data resp last user")}
    lite5 = {"w": _channel("w", "data strb user poison trace"), "b": _channel("b", "id idunq resp user trace"), "r": _channel("r", "id idunq data resp user poison trace")}
    ace5 = {"w": _channel("w", "data strb last user poison trace"), "b": _channel("b", "id resp user trace loop idunq"), "r": _channel("r", "id data resp last user poison trace loop idunq")}
    ac5, cr5 = _channel("ac", "addr vmidext trace"), _channel("cr", "trace")
    small = "id addr size prot user trace subsysid idunq".split()
    acp = "id addr len cache prot user domain snoop stashnid stashniden stashlpid stashlpiden trace mpam chunken idunq".split()
    keep = lambda fields, own: [f for f in fields if f in own]
    shapes = {
        "axi3": ("H.c", _pair(_CLASSIC[:8], _CLASSIC[:8]), {"w": _channel("w", "id data strb last"), "b": _channel("b", "id resp"), "r": _channel("r", "id data resp last")}, {}),
        "axi4": ("H.c", _pair(_CLASSIC, _CLASSIC), four, {}),
        "axi4-lite": ("H.c", _pair(["addr", "prot"], ["addr", "prot"]), {"w": _channel("w", "data strb"), "b": ["bresp"], "r": _channel("r", "data resp")}, {}),
        "axi5": ("L", _pair(full_w, full_r), five, {"ac": ac5, "cr": cr5}),
        "axi5-lite": ("L", _pair(small, small), lite5, {}),
        "ace": ("H.c", _pair([*_CLASSIC, "domain", "snoop", "bar", "unique"], [*_CLASSIC, "domain", "snoop", "bar"]), four, {"ac": _channel("ac", "addr snoop prot"), "cr": ["crresp"], "cd": _channel("cd", "data last")}),
        "ace-lite": ("H.c", _pair([*_CLASSIC, "domain", "snoop", "bar", "unique"], [*_CLASSIC, "domain", "snoop", "bar"]), four, {}),
        "ace5": ("H.c", _pair([*_CLASSIC, "domain", "snoop", "unique", *_ACE5], [*_CLASSIC, "domain", "snoop", "vmidext", *_ACE5]), ace5, {"ac": _channel("ac", "addr snoop prot vmidext trace"), "cr": _channel("cr", "resp trace nsaid"), "cd": _channel("cd", "data last poison trace")}),
        "ace5-lite": ("L", _pair(_less(full_w, _NEWEST), _less(full_r, _NEWEST)), five, {}),
        "ace5-lite-dvm": ("L", _pair(_less(full_w, _NEWEST, _MMU), _less(full_r, _NEWEST, _MMU)), {**five, "b": _less(five["b"], ["btagmatch"])}, {"ac": ac5, "cr": cr5}),
        "ace5-lite-acp": ("L", _pair(keep(full_w, acp), keep(full_r, acp)), {"w": ace5["w"], "b": lite5["b"], "r": _channel("r", "id idunq data resp last user poison trace chunkv chunknum chunkstrb")}, {}),
    }
    return {name: (issue, {"aw": aw, "w": rest["w"], "b": rest["b"], "ar": ar, "r": rest["r"], **extra}) for name, (issue, (aw, ar), rest, extra) in shapes.items()}


AXI = _axi()
AXI_CONTEXT = ("aclk", "aresetn")

#: The other protocols, context signals first; order matters.
AHB_LITE = "hclk hresetn htrans hready hwrite haddr hburst hmastlock hprot hsize hauser hwdata hwstrb hwuser hrdata hruser hbuser hresp".split()
AHB = {"ahb-lite": AHB_LITE, "ahb5": [*AHB_LITE[:11], "hnonsec", "hexcl", "hmaster", *AHB_LITE[11:], "hexokay"]}
AHB_REQUIRED = "hclk htrans hready hwrite".split()
AHB_ADDRESS = "htrans hwrite haddr hburst hmastlock hprot hsize hauser hnonsec hexcl hmaster".split()
AHB_IDLE, AHB_WRITE, AHB_READ, AHB_GOOD_READ, AHB_GOOD = "htrans haddr hmastlock".split(), "hwdata hwstrb hwuser".split(), ["hrdata"], ["hruser"], "hbuser hexokay".split()
APB = {
    "apb3": "pclk presetn psel penable pwrite pready paddr pwdata prdata pslverr".split(),
    "apb4": "pclk presetn psel penable pwrite pready paddr pprot pwdata pstrb prdata pslverr".split(),
    "apb5": "pclk presetn psel penable pwrite pready paddr pprot pnse pauser pwdata pstrb pwuser prdata pslverr pruser pbuser".split(),
}
APB_REQUIRED, APB_CONTEXT = "pclk psel penable pwrite".split(), "pclk presetn psel penable pready".split()
APB_COMPLETION, APB_WRITE, APB_READ = "prdata pslverr pruser pbuser".split(), "pwdata pwuser".split(), "prdata pruser".split()
ATB_A = "atclk atresetn atvalid atready atbytes atdata atid afvalid afready".split()
ATB = {"atb-a": ATB_A, "atb-b": [*ATB_A, "syncreq"], "atb-c": [*ATB_A, "syncreq"]}
ATB_PAYLOAD = "atbytes atdata atid".split()
STREAM = ("axi4-stream", "axi5-stream")
STREAM_PAYLOAD = "tdata tstrb tkeep tlast tid tdest tuser".split()
STREAM_SIGNALS = [*AXI_CONTEXT, "tvalid", "tready", *STREAM_PAYLOAD]
