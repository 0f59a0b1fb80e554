"""Keyword lists, labels and registries that results depend on."""

from __future__ import annotations

WHITELIST_KEYWORDS = ("login", "signin", "/auth/", "/auth?", "auth.", "sso", "oauth", "verify", "returnurl", "logout")

AFFILIATES = {
    "naver.com": ("pstatic.net", "nstatic.net"),
    "instagram.com": ("facebook.com", "fbcdn.net", "cdninstagram.com"),
    "facebook.com": ("instagram.com", "fbcdn.net", "cdninstagram.com"),
}

TRACKER_KEYWORDS = (
    "collect", "pixel", "logging", "logger", "/log/", "/log?", "beacon", "metric", "analytics", "/ads/", "/ads?",
    "adserver", "stats", "telemetry", "monitor", "insight", "impress", "measure", "report", "trace", "pulse", "record",
    "tracker", "tracking", "/track/", "/track?", ".track.", "/event/", "/event?", "event.", "events.",
    "/ping/", "/ping?", "/ping.", "segment.io", "segment.com", "cdn.segment.", "googletagmanager", "google-analytics",
    "doubleclick", "criteo", "hotjar", "crazyegg", "mixpanel", "appdynamics", "newrelic", "datadog", "facebook",
)

COOKIE_MARKS = ("path=/", "domain=", "expires=")

SENSITIVE_SOURCES = (
    "location.href", "location.hostname", "location.origin", "location.pathname", "document.URL", "document.cookie",
    "screen.width", "screen.height", "screen.colorDepth", "navigator.userAgent", "navigator.language",
    "navigator.platform", "Date", "performance.now", "Math.random", "Obfuscated_Property", "Obfuscated_Call", "Dynamic_Source",
)

FINGERPRINT_PREFIXES = ("screen.", "navigator.")
RENDER_SINKS = ("innerHTML", "textContent", "innerText", "outerHTML", "insertAdjacentHTML", "value", "document.write")
UI_NODES = ("StoreFrameInst", "PhiInst", "LoadFrameInst")
SHORT_PATH_NODES = ("LoadPropertyInst", "StorePropertyInst", "CallInst")
EXFIL_SINKS = ("Network", "Navigation")
EVASION = "(Evasion Suspected)"
DYNAMIC, HOLE = "DYNAMIC_URL", "{VAR}"
HYBRID_NOTE = " (🌟 Hybrid Reconstructed)"
PREDICTED_NOTE = " (🌟 Predicted 1st-Party Target / CNAME Cloaked)"

#: Label, rule number, statistic.
LABELS = (
    ("Isolated_Exfiltration (Rule 1)", 1, "isolated_exfil"),
    ("Parasitic_Branch (Rule 2)", 2, "parasitic_branch"),
    ("Dual_Execution_Context (Rule 3)", 3, "dual_context"),
    ("DOM_Evasion (Rule 4)", 4, "evasion_dom"),
    ("DOM_Evasion (Rule 4) [Dynamic Obfuscated]", 4, "evasion_dynamic"),
    ("Evasion_with_Camouflage (Rule 4) [Disguised Tracker]", 4, "camouflaged_3rd_party"),
    ("Semantic_CrossValidation (Rule 5) [Deterministic]", 5, "semantic_crossval"),
    ("Semantic_CrossValidation (Rule 5) [Probabilistic]", 5, "semantic_crossval"),
    ("Fingerprinting_Leak (Rule 5)", 5, "fingerprinting"),
)
R1, R2, R3, R4, R4_DYNAMIC, R4_CAMOUFLAGE, R5_CERTAIN, R5_LIKELY, R5_FINGERPRINT = (x[0] for x in LABELS)

#: Sources of the taint analysis: name, kind (P property, M method, C constructor, G global function), what it returns.
SOURCES = (
    ("navigator.userAgent", "P", "primitive"),
    ("navigator.appVersion", "P", "primitive"),
    ("navigator.platform", "P", "primitive"),
    ("navigator.language", "P", "primitive"),
    ("navigator.languages", "P", "array"),
    ("navigator.vendor", "P", "primitive"),
    ("navigator.vendorSub", "P", "primitive"),
    ("navigator.product", "P", "primitive"),
    ("navigator.productSub", "P", "primitive"),
    ("navigator.oscpu", "P", "primitive"),
    ("navigator.hardwareConcurrency", "P", "primitive"),
    ("navigator.deviceMemory", "P", "primitive"),
    ("navigator.maxTouchPoints", "P", "primitive"),
    ("navigator.geolocation", "P", "object"),
    ("navigator.plugins", "P", "object"),
    ("navigator.mimeTypes", "P", "object"),
    ("navigator.mediaDevices", "P", "object"),
    ("screen.width", "P", "primitive"),
    ("screen.height", "P", "primitive"),
    ("screen.availWidth", "P", "primitive"),
    ("screen.availHeight", "P", "primitive"),
    ("screen.colorDepth", "P", "primitive"),
    ("screen.pixelDepth", "P", "primitive"),
    ("screen.orientation", "P", "object"),
    ("document.cookie", "P", "primitive"),
    ("document.referrer", "P", "primitive"),
    ("document.domain", "P", "primitive"),
    ("document.URL", "P", "primitive"),
    ("document.documentURI", "P", "primitive"),
    ("document.title", "P", "primitive"),
    ("location.href", "P", "primitive"),
    ("location.protocol", "P", "primitive"),
    ("location.host", "P", "primitive"),
    ("location.hostname", "P", "primitive"),
    ("location.port", "P", "primitive"),
    ("location.pathname", "P", "primitive"),
    ("location.search", "P", "primitive"),
    ("location.hash", "P", "primitive"),
    ("location.origin", "P", "primitive"),
    ("window.name", "P", "primitive"),
    ("window.origin", "P", "primitive"),
    ("window.innerWidth", "P", "primitive"),
    ("window.innerHeight", "P", "primitive"),
    ("window.outerWidth", "P", "primitive"),
    ("window.outerHeight", "P", "primitive"),
    ("window.devicePixelRatio", "P", "primitive"),
    ("localStorage.getItem", "M", "primitive"),
    ("sessionStorage.getItem", "M", "primitive"),
    ("Date.now", "M", "primitive"),
    ("Date", "C", "object"),
    ("performance.now", "M", "primitive"),
    ("performance.timing", "P", "object"),
    ("performance.navigation", "P", "object"),
    ("performance.memory", "P", "object"),
    ("fetch", "G", "promise"),
    ("XMLHttpRequest.responseText", "P", "primitive"),
    ("XMLHttpRequest.response", "P", "object"),
    ("XMLHttpRequest.getResponseHeader", "M", "primitive"),
    ("window.getSelection", "M", "object"),
    ("document.getSelection", "M", "object"),
    ("navigator.clipboard.readText", "M", "promise"),
    ("navigator.clipboard.read", "M", "promise"),
    ("history.length", "P", "primitive"),
    ("history.state", "P", "object"),
    ("indexedDB.open", "M", "object"),
    ("WebSocket", "C", "object"),
    ("CanvasRenderingContext2D.getImageData", "M", "object"),
    ("HTMLCanvasElement.toDataURL", "M", "primitive"),
    ("HTMLCanvasElement.toBlob", "M", "promise"),
    ("WebGLRenderingContext.getParameter", "M", "primitive"),
    ("WebGLRenderingContext.getSupportedExtensions", "M", "array"),
    ("AudioContext", "C", "object"),
    ("AudioContext.createOscillator", "M", "object"),
    ("navigator.getBattery", "M", "promise"),
    ("navigator.connection", "P", "object"),
    ("navigator.mediaDevices.enumerateDevices", "M", "promise"),
    ("navigator.mediaDevices.getUserMedia", "M", "promise"),
    ("navigator.getGamepads", "M", "array"),
    ("Notification.permission", "P", "primitive"),
    ("DeviceOrientationEvent", "C", "object"),
    ("DeviceMotionEvent", "C", "object"),
    ("MessageEvent.data", "P", "object"),
    ("MessageEvent.origin", "P", "primitive"),
    ("HTMLInputElement.value", "P", "primitive"),
    ("HTMLTextAreaElement.value", "P", "primitive"),
    ("HTMLSelectElement.value", "P", "primitive"),
    ("FileReader.result", "P", "primitive"),
    ("File.name", "P", "primitive"),
    ("File.size", "P", "primitive"),
    ("crypto.getRandomValues", "M", "object"),
    ("crypto.randomUUID", "M", "primitive"),
)

#: Sinks of the taint analysis: name, type, method or not.
SINKS = (
    ("fetch", "Network", True), ("XMLHttpRequest.open", "Network", True), ("XMLHttpRequest.send", "Network", True),
    ("XMLHttpRequest.setRequestHeader", "Network", True), ("navigator.sendBeacon", "Network", True), ("src", "Network", False),
    ("WebSocket.send", "Network", True), ("localStorage.setItem", "Storage", True), ("sessionStorage.setItem", "Storage", True),
    ("document.cookie", "Storage", False), ("document.write", "XSS", True), ("document.writeln", "XSS", True),
    ("innerHTML", "XSS", False), ("outerHTML", "XSS", False), ("eval", "Code Injection", True), ("Function", "Code Injection", True),
    ("setTimeout", "Code Injection", True), ("setInterval", "Code Injection", True), ("location.href", "Navigation", False),
    ("location.assign", "Navigation", True), ("location.replace", "Navigation", True), ("window.open", "Navigation", True),
)

#: Places of a sink's URL and data among its arguments, -1 without one.
SINK_ARGUMENTS = (
    ("fetch", 0, 1), ("XMLHttpRequest.open", 1, -1), ("XMLHttpRequest.send", -1, 0), ("XMLHttpRequest.setRequestHeader", -1, 1),
    ("navigator.sendBeacon", 0, 1), ("src", -1, 0), ("WebSocket.send", -1, 0), ("localStorage.setItem", -1, 1), ("sessionStorage.setItem", -1, 1),
    ("document.cookie", -1, 0), ("document.write", -1, 0), ("document.writeln", -1, 0), ("innerHTML", -1, 0), ("outerHTML", -1, 0), ("eval", -1, 0),
    ("Function", -1, 0), ("setTimeout", -1, 0), ("setInterval", -1, 0), ("location.href", -1, 0), ("location.assign", -1, 0), ("location.replace", -1, 0),
    ("window.open", 0, -1),
)

ENCODING_CALLS = ("atob", "btoa", "decodeURIComponent", "unescape", "decodeURI")

#: Properties that are sources whatever object they are read from.
FINGERPRINT_PROPERTIES = (
    "userAgent", "platform", "deviceMemory", "hardwareConcurrency", "language", "languages", "connection", "plugins",
    "doNotTrack", "toDataURL", "AudioContext", "timeZone",
)

#: Names under which a global never carries taint.
IGNORED_GLOBALS = (
    "exports", "module", "window", "self", "global", "document", "console", "process", "now", "date", "time", "expires",
    "path", "domain", "secure", "undefined", "null", "true", "false", "prototype", "length", "width", "height",
)

#: Method names that link no call to a function.
COMMON_METHODS = (
    "add", "get", "set", "push", "pop", "call", "apply", "bind", "toString", "hasOwnProperty",
    "slice", "splice", "map", "filter", "forEach", "length", "qb", "sb", "Fh", "Wd",
)

#: Sink type, severity, category.
SEVERITIES = (
    ("Network", "[CRITICAL]", "Data Exfiltration (Tracking)"), ("Storage", "[WARNING]", "Fingerprinting / Storage"),
    ("Code Injection", "[HIGH]", "Code Injection"), ("XSS", "[MEDIUM]", "DOM Manipulation (XSS)"), ("Navigation", "[LOW]", "Page Navigation"),
)

#: Events that a page can listen to.
EVENT_NAMES = (
    "click", "dblclick", "mousedown", "mouseup", "mousemove", "mouseenter", "mouseleave", "mouseover", "mouseout", "contextmenu",
    "keydown", "keyup", "keypress", "submit", "input", "change", "focus", "blur",
    "touchstart", "touchend", "touchmove", "touchcancel", "drag", "dragstart", "dragend", "dragenter", "dragleave", "dragover", "drop",
    "copy", "cut", "paste", "online", "offline", "message", "messageerror", "storage", "deviceorientation", "devicemotion",
)

#: Properties of events that carry data.
EVENT_PROPERTIES = (
    "clientX", "clientY", "screenX", "screenY", "pageX", "pageY", "offsetX", "offsetY", "button", "buttons", "relatedTarget",
    "key", "code", "keyCode", "charCode", "which", "altKey", "ctrlKey", "shiftKey", "metaKey",
    "touches", "targetTouches", "changedTouches", "dataTransfer", "clipboardData",
    "target", "currentTarget", "type", "timeStamp", "data", "origin", "source",
)

#: Calls whose first argument names a module that is loaded later.
RESOURCE_CALLS = ("__jsResource", "__conditionallySplitJSResource", "JSResource", "ConditionallySplitJSResource", "prefetchImport")
PREFETCHED_CALLS = ("PrefetchedJSResource",)
