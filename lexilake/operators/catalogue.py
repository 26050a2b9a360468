"""The rule catalogue as data.

Phrase lists adapt the public page "Wikipedia:Signs of AI writing" (CC BY-SA); the explanations are
written for this catalogue. A hit is a style signal: it does not determine who or what wrote a text.

Patterns are written in a neutral dialect and rendered by ``functions.dialect``: ``\\b``, ``\\w``,
``\\d`` have ASCII meaning, ``\\s`` is Unicode white space and the byte-order mark, ``^`` and ``$`` stand
for line ends under flag ``m``, and ``\\p{Pict}`` for extended pictographs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

TIERS = ("low", "medium", "high", "critical")
TIER_SEVERITY = {"critical": "error", "high": "error", "medium": "warn", "low": "off"}
RULE_SEVERITY = {"rule_of_three": "off"}
#: Categories that read the masked text before typographic folding.
STRUCTURAL = ("emoji_formatting", "formatting_tells")


@dataclass(frozen=True)
class Pattern:
    id: str
    flags: str
    regex: str
    examples: tuple = ()
    vendor: str | None = None
    era: str | None = None


@dataclass(frozen=True)
class Category:
    id: str
    label: str
    tier: str
    weight: int
    cap: int
    why: str
    caution: str
    patterns: tuple = field(default_factory=tuple)


P = Pattern
#: Rules, weights, caps, labels, patterns and examples, in catalogue order.
CATEGORIES: tuple[Category, ...] = (
    Category("tool_artifacts", "Chatbot tool artifacts", "critical", 40, 60, "Citation or rendering markup copied along from a chat interface.", "A text about such markup may quote it.", (
        P("openai_citation_markup", "", r":?contentReference\[oaicite:\d+\]|oai_citation:?\s*\d*|\boaicite\b", (":contentReference[oaicite:16]{index=16}", "[oai_citation:0‡example.com]"), "ChatGPT"),
        P("openai_turn_tokens", "", r"\b(?:cite)?turn\d+(?:search|image|news|file|view|forecast)\d+\b", ("citeturn0search1", "turn0image4"), "ChatGPT"),
        P("openai_attribution_json", "", r"\{\s*\"attribution\"\s*:\s*\{\s*\"attributableIndex\"", ('({"attribution":{"attributableIndex":"1009-1"}})',), "ChatGPT"),
        P("gemini_cite_markers", "", r"\[cite:\s*\d+(?:\s*,\s*\d+)*\]|\[cite_start\]", ("[cite: 17]", "[cite: 19, 20, 21]"), "Gemini"),
        P("gemini_span_markers", "", r"\[span_\d+\]\((?:start|end)_span\)", ("[span_2](start_span)",), "Gemini"),
        P("grok_cards", "", r"<grok-card\b|grok_render_citation_card_json|data-type=\"citation_card\"", ('<grok-card data-id="e8ff4f" data-type="citation_card">',), "Grok"),
        P("deepseek_lenticular", "", r"【\d+†L?\d+(?:-L?\d+)?】", ("【85†L261-269】",), "DeepSeek"),
        P("perplexity_tags", "", r"\[(?:attached_file|web|search):\s*\d+\]|ppl-ai-file-upload", ("[attached_file:1]", "[web:1]"), "Perplexity"),
        P("writing_variant_block", "i", r":{3}\s*(?:writing|ecriture|[éÉ]criture)\s*\{\s*(?:variant|variante)\s*=", (':::writing{variant="document" id="68427"}',), "unclassified"),
        P("chatgpt_utm", "i", r"utm_source=(?:chatgpt\.com|openai)", ("https://example.com/?utm_source=chatgpt.com",), "ChatGPT"),
    )),
    Category("ai_self_reference", "Model self-identification", "critical", 35, 50, "A sentence in which an assistant speaks of its own nature or limits.", "Quotations in texts about assistants.", (
        P("as_an_ai", "i", r"\bas an? (?:AI|artificial intelligence)(?: language)?(?: model| assistant| system)?\b", ("As an AI language model, I cannot...",)),
        P("as_a_llm", "i", r"\bas a large language model\b", ("As a large language model, I do not have...",)),
        P("no_personal_capacity", "i", r"\bI (?:don't|do not|cannot|can't) have (?:personal |any )?(?:opinions|feelings|beliefs|preferences|access to real[- ]time|the ability to browse)\b", ("I don't have personal opinions, but...",)),
        P("language_model_self", "i", r"\bI(?:'m| am) (?:an? )?(?:AI|language model|chatbot|virtual assistant)\b", ("I'm an AI, so I...",)),
    )),
    Category("knowledge_cutoff", "Knowledge-cutoff and source-gap hedging", "high", 14, 40, "Mentions of a training date, or of how little the sources hold.", "Scholars also report scarce records.", (
        P("last_update", "i", r"\b(?:as of|up to|until) my (?:last |latest |most recent )?(?:knowledge |training |data )?(?:update|cutoff|cut-off)\b", ("As of my last knowledge update, ...",)),
        P("available_information", "i", r"\bbased on (?:the )?(?:available|provided) (?:information|sources|data)\b|\bin the (?:provided|given) sources\b", ("Based on available information, ...",)),
        P("details_limited", "i", r"\b(?:while |although )?(?:specific |further |additional )?details (?:are|remain) (?:limited|scarce|sparse|not widely (?:available|documented|disclosed))\b", ("While specific details are limited, ...",)),
        P("not_widely_documented", "i", r"\bnot widely (?:available|documented|disclosed|reported|publicised|publicized)\b", ("His early career is not widely documented.",)),
        P("private_life_speculation", "i", r"\bkeeps? (?:much of )?(?:his|her|their) personal life private\b|\bmaintains? a low profile\b", ("She keeps much of her personal life private.",)),
        P("inference_disclosure", "i", r"\bI(?:'ve| have) inferred\b|\bmy analysis is based on\b|\blikely due to limited (?:mainstream )?(?:exposure|coverage|documentation)\b", ("I've inferred common motifs...",)),
    )),
    Category("collaborative_scaffolding", "Conversational scaffolding", "high", 12, 45, "Courtesies of a chat that have no place in a finished text.", "Letters and teaching texts do address their readers.", (
        P("hope_this_helps", "i", r"\bI hope (?:this|that) helps\b|\bhope this (?:helps|is helpful)\b", ("I hope this helps!",)),
        P("enthusiastic_openers", "", r"(?:^|[.!?]\s+|\n)\s*(?:Certainly|Absolutely|Of course|Sure thing|Great question|Excellent question|Fantastic question|Happy to help)\s*[!,.]", ("Certainly! Here is a summary.",)),
        P("offer_more", "i", r"\bwould you like me to\b|\blet me know if (?:you|there|that|I)\b|\bfeel free to (?:ask|reach out|let me know)\b|\bif you(?:'d| would) like,? I can\b", ("Let me know if you would like me to expand this.",)),
        P("here_is_a", "i", r"\bhere(?:'s| is| are)\s+(?:a|an|the)\s+(?:brief |quick |detailed |comprehensive |more detailed )?(?:breakdown|overview|summary|rundown|deep dive|look at)\b", ("Here's a detailed breakdown of the options.",)),
        P("lets_dive_in", "i", r"\blet(?:'s| us) (?:dive (?:in|into)|explore|take a (?:look|closer look)|unpack|break (?:this|it) down|get started)\b", ("Let's dive into the details.",)),
        P("youre_right", "i", r"\byou(?:'re| are) (?:absolutely |completely |quite )?right\b|\bgreat point\b|\bthat(?:'s| is) a (?:great|excellent|fair) point\b", ("You're absolutely right to point that out.",)),
        P("meta_offer_feedback", "i", r"\bhappy to (?:address|answer|clarify|expand on) any (?:further|additional|other)\b|\bI(?:'m| am) open to (?:any |further )?(?:suggestions|feedback|guidance|input)\b|\bI would (?:greatly )?appreciate (?:your )?(?:guidance|feedback|input)\b", ("Happy to address any further concerns.",)),
    )),
    Category("placeholder_text", "Unfilled placeholders", "critical", 25, 40, "Slots of a template that nobody filled in.", "Manuals and code use slots on purpose.", (
        P("bracket_insert", "i", r"\[(?:INSERT|ADD|ENTER|YOUR|PASTE|TODO|TBD|XX+)[^\]\n]{0,40}\]", ("[INSERT SOURCE URL]", "[Your Name Here]")),
        P("screaming_snake_slot", "", r"\b(?:INSERT|PASTE|ADD)_[A-Z_]{3,}\b|\bSOURCE_(?:URL|PUBLISHER|NAME)\b|\bURL_HERE\b", ("INSERT_SOURCE_URL", "PASTE_URL_HERE")),
        P("dummy_date", "", r"\b(?:19|20)\d{2}-(?:xx|XX|mm|MM)-(?:xx|XX|dd|DD)\b|\bYYYY-MM-DD\b", ("2025-xx-xx",)),
        P("delete_before_submission", "i", r"\b(?:delete|remove) this (?:section|line|note|paragraph) before (?:submission|publishing|sending)\b", ("Delete this section before submission.",)),
    )),
    Category("significance_statements", "Significance and legacy inflation", "medium", 7, 45, "A claim that a fact matters, put in place of the fact.", "Obituaries and citations for awards make such claims in earnest.", (
        P("stands_as_testament", "i", r"\b(?:stands?|serves?|remains?) as an? (?:enduring |lasting |powerful |living |stark )?(?:testament|testimony|reminder|symbol|beacon|hallmark|cornerstone|monument|celebration)\b", ("The bridge stands as a testament to Victorian engineering.",)),
        P("vital_role", "i", r"\b(?:plays?|played|playing|has played) an? (?:vital|crucial|pivotal|significant|central|key|critical|important|instrumental|major) role\b", ("She played a pivotal role in the negotiations.",)),
        P("underscores_importance", "i", r"\b(?:underscore[sd]?|highlight(?:s|ed)?|emphasi[sz]e[sd]?|reflect(?:s|ed)?|demonstrate[sd]?|illustrate[sd]?) (?:the |its |their |his |her )?(?:importance|significance|centrality|enduring|lasting|ongoing|continued|broader|vital)\b", ("This underscores the importance of early testing.",)),
        P("enduring_legacy", "i", r"\b(?:enduring|lasting|indelible|profound|far-reaching|ongoing) (?:legacy|impact|influence|mark|imprint|significance|relevance|contribution)\b", ("He left an indelible mark on the discipline.",)),
        P("turning_point", "i", r"\b(?:key |major |critical |defining )?turning point\b|\bwatershed moment\b|\bmark(?:s|ed|ing)? a (?:shift|departure|new (?:chapter|era)|milestone)\b|\bsetting the stage for\b", ("1968 marked a turning point for the movement.",)),
        P("evolving_landscape", "i", r"\b(?:ever-)?(?:evolving|changing|shifting|dynamic) (?:landscape|world|environment|ecosystem|terrain)\b|\bin (?:today's|the modern) (?:fast-paced|rapidly changing|digital) (?:world|landscape|environment)\b", ("In the ever-evolving landscape of cybersecurity...",)),
        P("deeply_rooted", "i", r"\bdeeply (?:rooted|embedded|ingrained|intertwined)\b|\breflects? (?:a )?broader (?:trends?|shifts?|patterns?|movements?)\b|\bfocal point\b", ("The practice is deeply rooted in local tradition.",)),
        P("contributing_to", "i", r"\bcontribut(?:es?|ed|ing) to (?:the )?(?:rich |broader |ongoing |overall )?(?:tapestry|fabric|mosaic|development|discourse|understanding|conversation|dialogue)\b", ("...contributing to the rich tapestry of city life.",)),
    )),
    Category("participial_tackon", "Trailing participial commentary", "medium", 8, 40, "A closing -ing clause that judges and adds nothing.", "Correct grammar, and at times it does inform.", (
        P("ing_significance_clause", "i", r",\s+(?:highlighting|emphasi[sz]ing|underscoring|showcasing|reflecting|demonstrating|illustrating|signalling|signaling|cementing|solidifying|reinforcing|affirming|confirming|marking|symbolizing|symbolising|embodying|fostering|cultivating|ensuring|encompassing)\s+(?:its|their|his|her|the|a|an)\b", (", highlighting its cultural significance.",)),
        P("creating_a_space", "i", r"\bcreating a (?:space|sense|environment|community|platform|foundation) (?:where|for|of)\b|\bfostering a (?:sense|culture|spirit|climate) of\b", ("...fostering a sense of community.",)),
        P("ongoing_relevance", "i", r"\b(?:demonstrating|confirming|illustrating|reflecting|affirming)\s+(?:the\s+)?(?:ongoing|enduring|lasting|continued|persistent)\s+(?:relevance|influence|importance|appeal|significance)\b", ("...confirming the enduring relevance of the form.",)),
    )),
    Category("negative_parallelism", "Negative parallelism", "medium", 10, 45, "A thing is said by denying a lesser one first.", "An old device of speakers; repetition is what tells.", (
        P("not_only_but_also", "i", r"\bnot only\b[^.!?\n]{1,80}?\bbut(?: also)?\b", ("Not only did it fail, but it also cost millions.",)),
        P("not_just_its", "i", r"\bnot (?:just|merely|simply)\b[^.!?\n]{1,80}?[,;—-]\s*(?:it(?:'s| is)|they(?:'re| are)|but)\b", ("It's not just a phone — it's a platform.",)),
        P("its_not_its", "i", r"\bit(?:'s| is)\s+not\s+(?:about\s+)?[^.!?\n]{1,60}?[,;—-]\s*it(?:'s| is)\b", ("It's not about speed, it's about accuracy.",)),
        P("no_no_just", "i", r"\bno\s+\w+(?:\s+\w+)?,\s+no\s+\w+(?:\s+\w+)?,\s+(?:just|only)\b", ("No hype, no jargon, just results.",)),
        P("isnt_x_its_y", "i", r"\b(?:this|that|it|there)\s+(?:is|was)\s?n(?:'|o)t\s+[^.!?\n]{1,60}?[—-]\s*(?:it(?:'s| is)|that(?:'s| is))\b", ("This isn't a setback — it's a redirection.",)),
        P("rather_than_contrast", "i", r"\b(?:prioriti[sz]ing|choosing|favou?ring|emphasi[sz]ing|seeking)\b[^.!?\n]{1,70}?\brather than\b", ("...prioritizing consolidation rather than ideological purity.",)),
    )),
    Category("rule_of_three", "Mechanical triads", "medium", 5, 25, "Lists of three where the matter does not ask for three.", "Ordinary English; only many of them in a paragraph say something.", (
        P("adjective_triad", "", r"\b(\w+ly\s+)?(\w{4,}),\s+(\w{4,}),\s+and\s+(\w{4,})\b", ("clear, concise, and compelling",)),
        P("triad_closer", "i", r"\b\w+,\s+\w+,\s+and\s+\w+\s+(?:alike|together|combined|all at once)\b", ("critics, fans, and scholars alike",)),
    )),
    Category("ritual_conclusion", "Ritual conclusions", "medium", 9, 30, "A wrap-up that repeats what was just read.", "Papers and reports have real conclusions.", (
        P("in_conclusion", "", r"(?:^|\n|[.!?]\s+)\s*(?:In (?:conclusion|summary|essence|short)|Ultimately|Overall|To sum up|All in all|In the end),", ("In conclusion, the evidence is mixed.",)),
        P("conclusion_heading", "m", r"^[ \t]*#{1,6}\s*(?:Conclusion|Summary|Final [Tt]houghts|Key [Tt]akeaways?|Wrapping [Uu]p|The [Bb]ottom [Ll]ine|Future [Oo]utlook|Looking [Aa]head)\s*:?\s*$", ("## Key Takeaways",)),
        P("bottom_line", "i", r"\bthe bottom line (?:is|here is)\b|\bat the end of the day,", ("The bottom line is that costs rose.",)),
    )),
    Category("challenges_and_future", "Challenges-and-future formula", "medium", 9, 30, "A difficulty granted, then reassurance, without a fact that could be checked.", "Policy papers are meant to do this.", (
        P("despite_challenges", "i", r"\bdespite (?:these |its |the |such )?(?:challenges|obstacles|setbacks|difficulties|limitations|criticism)\b", ("Despite these challenges, the project continues to thrive.",)),
        P("faces_challenges", "i", r"\bfaces? (?:several |a number of |numerous |significant |ongoing )?(?:challenges|hurdles|obstacles)(?: that must be addressed)?\b", ("The sector faces several challenges that must be addressed.",)),
        P("continues_to", "i", r"\bcontinue[sd]? to (?:evolve|thrive|grow|shape|serve|inspire|play|provide|resonate|attract)\b", ("The festival continues to thrive.",)),
        P("future_lies_in", "i", r"\bthe future of\b[^.!?\n]{1,60}?\b(?:lies in|will depend on|hinges on|remains (?:bright|uncertain|promising))\b|\bpositions? (?:it|them|itself) (?:well )?for (?:future|continued|further)\b", ("The future of the format lies in its ability to adapt.",)),
        P("sparked_conversation", "i", r"\b(?:sparked|prompted|generated|ignited|raised) (?:broader |wider |important |renewed )?(?:conversations?|debates?|discussions?|reflections?|questions?) (?:about|around|regarding)\b", ("The ruling sparked broader conversations about privacy.",)),
    )),
    Category("vague_attribution", "Vague attribution", "medium", 8, 35, "A consensus without anyone who could be named.", "News under a deadline does it too; look for a name nearby.", (
        P("experts_say", "i", r"\b(?:experts|analysts|observers|critics|commentators|scholars|researchers|historians|industry (?:experts|analysts|watchers))\s+(?:say|said|argue|argued|note|noted|believe|suggest|contend|have (?:noted|argued|suggested|cited|observed))\b", ("Experts argue that the trend will continue.",)),
        P("studies_have_shown", "i", r"\b(?:studies|research|reports|surveys|data)\s+(?:have |has )?(?:shown|suggest(?:ed)?|indicate[sd]?|reveal(?:ed)?|found)\b(?![^.!?\n]{0,60}\b(?:19|20)\d{2}\b)", ("Studies have shown a link between the two.",)),
        P("several_sources", "i", r"\b(?:several|multiple|various|numerous|a number of)\s+(?:sources|publications|outlets|commentators|accounts)\b", ("Several sources suggest otherwise.",)),
        P("widely_regarded", "i", r"\b(?:widely|generally|commonly|often)\s+(?:regarded|considered|recognised|recognized|acknowledged|seen|viewed|described|praised|hailed)\s+as\b", ("Widely regarded as a masterpiece.",)),
        P("media_presence", "i", r"\bmaintains? an? (?:active|strong|significant|growing) (?:social media|digital|online|public) presence\b|\b(?:featured|profiled|covered) in (?:local|regional|national|international) (?:media )?outlets\b", ("She maintains an active social media presence.",)),
    )),
    Category("editorial_hedging", "Editorialising hedges", "medium", 6, 30, "The reader is told how to weigh a fact.", "Common in texts that teach.", (
        P("important_to_note", "i", r"\bit(?:'s| is) (?:important|crucial|essential|vital|worth|useful|helpful|necessary) to (?:note|remember|consider|recognise|recognize|understand|emphasi[sz]e|highlight|acknowledge|point out|keep in mind)\b", ("It's important to note that results vary.",)),
        P("worth_noting", "i", r"\b(?:it is |it's )?worth (?:noting|mentioning|considering|remembering) that\b|\bnotably,|\bimportantly,", ("Worth noting that the sample was small.",)),
        P("may_vary", "i", r"\bmay vary (?:depending|based) on\b|\bresults (?:may|can) vary\b|\byour mileage may vary\b", ("Costs may vary depending on region.",)),
        P("both_sides", "i", r"\bwhile\b[^.!?\n]{1,70}?,\s*it(?:'s| is) (?:also )?(?:important|worth|crucial|essential)\b", ("While the data is promising, it's important to remain cautious.",)),
    )),
    Category("promotional_puffery", "Promotional puffery", "medium", 6, 35, "The voice of a brochure where facts are missing.", "Advertising is meant to sound so.", (
        P("nestled_in_heart", "i", r"\bnestled (?:in|among|between|within)\b|\bin the heart of\b|\b(?:serves?|acts?) as (?:the |a )?gateway\b|\bhidden gem\b", ("Nestled in the heart of the old town...",)),
        P("breathtaking_adjectives", "i", r"\b(?:breathtaking|stunning|captivating|mesmeri[sz]ing|awe-inspiring|picturesque|idyllic|charming|quaint|bustling|vibrant|thriving|renowned|acclaimed|groundbreaking|revolutionary|cutting-edge|state-of-the-art|world-class|unparalleled|unrivalled|unrivaled)\b", ("a breathtaking view of the valley",)),
        P("rich_tapestry", "i", r"\b(?:rich|vibrant|diverse|colou?rful|intricate) (?:tapestry|mosaic|blend|array|heritage|history|culture|tradition)\b", ("a rich tapestry of influences",)),
        P("commitment_to", "i", r"\b(?:unwavering|steadfast|deep|strong|ongoing) commitment to\b|\bdedication to (?:excellence|quality|innovation|sustainability)\b", ("their unwavering commitment to quality",)),
        P("boasts", "i", r"\bboasts (?:a|an|the|over|more than|some)\b", ("The campus boasts a modern library.",)),
    )),
    Category("copula_avoidance", "Copula avoidance", "low", 3, 24, "Grander verbs where is, are or has would do.", "Each has honest uses; only density counts.", (
        P("serves_as", "i", r"\b(?:serves?|served|stands?|stood|functions?|operates?|acts?|emerges?|positions? itself) as (?:a|an|the|one of)\b", ("The hall serves as a community centre.",)),
        P("represents_a", "i", r"\brepresents? (?:a|an|one of|the)\b|\bmarks? (?:a|an|the) (?:first|beginning|start|shift|milestone)\b", ("The move represents a significant change.",)),
        P("features_offers", "i", r"\b(?:features?|offers?|houses?|showcases?|encompasses|comprises|holds the distinction of being)\s+(?:a|an|the|over|more than|several|numerous)\b", ("The building features a glass atrium.",)),
    )),
    Category("ai_vocabulary", "Overrepresented vocabulary", "low", 2, 30, "Words that became measurably more frequent after 2022.", "Ordinary words; a single one means nothing, and formal writers use them more.", (
        P("era_gpt4", "i", r"\b(?:delv(?:e|es|ed|ing)|tapestr(?:y|ies)|testament|pivotal|meticulous(?:ly)?|intricac(?:y|ies)|intricate|underscor(?:e|es|ed|ing)|bolster(?:ed|ing)?|garner(?:ed|ing)?|interplay|multifaceted|nuanced)\b", ("delve into the intricacies",), None, "2023 to mid-2024"),
        P("era_gpt4o", "i", r"\b(?:showcas(?:e|es|ed|ing)|foster(?:s|ed|ing)?|align(?:s|ed|ing)? with|enhanc(?:e|es|ed|ing)|enduring|crucial|vibrant|holistic|seamless(?:ly)?|robust|comprehensive|leverage[sd]?|realm|landscape)\b", ("a seamless and robust solution",), None, "mid-2024 to mid-2025"),
        P("era_current", "i", r"\b(?:emphasi[sz]ing|highlighting|showcasing|deep dive|actionable|streamlin(?:e|es|ed|ing)|empower(?:s|ed|ing)?|unlock(?:s|ed|ing)? the (?:potential|power)|game[- ]chang(?:er|ing)|paradigm shift)\b", ("unlock the potential of your data",), None, "mid-2025 onward"),
        P("sentence_initial_additionally", "m", r"(?:^|\n)\s*(?:Additionally|Moreover|Furthermore|Notably|Consequently|Nevertheless|Nonetheless),", ("Additionally, the cost fell.",)),
    )),
    Category("business_jargon", "Consulting jargon", "low", 3, 24, "Corporate speech, whatever the subject.", "A living dialect in its own habitat.", (
        P("synergy_family", "i", r"\b(?:synerg(?:y|ies|istic)|actionable insights?|value[- ]add(?:ed)?|best[- ]in[- ]class|mission[- ]critical|core competenc(?:y|ies)|low[- ]hanging fruit|move the needle|circle back|touch base|boil the ocean|north star metric)\b", ("actionable insights that move the needle",)),
        P("stakeholder_speak", "i", r"\b(?:key stakeholders?|cross[- ]functional|end[- ]to[- ]end|scalable solutions?|drive (?:growth|value|impact|adoption)|operationali[sz]e|ideate|bandwidth for)\b", ("align key stakeholders end-to-end",)),
        P("transformation_speak", "i", r"\b(?:digital transformation|thought leader(?:ship)?|disrupt(?:ive|ion)? (?:innovation|technolog)|next[- ]generation|future[- ]proof|holistic approach|strategic imperative)\b", ("a holistic approach to digital transformation",)),
    )),
    Category("data_analysis_phrases", "Analysis-report register", "low", 4, 24, "Set phrases around numbers, often thin ones.", "Usual in analysts' reports.", (
        P("data_reveals", "i", r"\bthe (?:data|numbers|figures|results|findings|evidence|analysis) (?:reveals?|shows?|suggests?|tells? (?:a|us)|paints? a (?:picture|clear picture)|speaks? for itself)\b", ("The data paints a clear picture.",)),
        P("at_a_glance", "i", r"\b(?:at a glance|key (?:takeaways?|findings?|highlights?|metrics|insights?)|by the numbers|tl;?dr)\b", ("Key takeaways at a glance",)),
        P("deep_dive_analysis", "i", r"\b(?:let(?:'s| us) )?(?:take a )?(?:deep dive|closer look) (?:into|at)\b|\bdiving deeper\b|\bunpack(?:ing)? the (?:data|numbers|findings)\b", ("A deep dive into the quarterly figures",)),
        P("suggests_trend", "i", r"\b(?:indicat(?:es?|ing)|suggest(?:s|ing)?|point(?:s|ing)? to) a (?:growing|clear|strong|significant|notable|marked|worrying|promising) (?:trend|shift|correlation|pattern|increase|decline)\b", ("This points to a growing trend.",)),
    )),
    Category("emoji_formatting", "Emoji as structure", "high", 12, 36, "Headings and list items that open with a pictograph.", "Release notes and chats do it by custom.", (
        P("emoji_heading", "m", r"^[ \t]*#{1,6}\s*\p{Pict}", ("## 🚀 Getting Started",)),
        P("emoji_bullet", "m", r"^[ \t]*(?:[-*+]|\d+\.)\s+\p{Pict}", ("- ✅ Ship the feature",)),
        P("emoji_label_line", "m", r"^[ \t]*\p{Pict}(?:[️‍]|\p{Pict})*\s*\*{0,2}[A-Z][^\n]{0,60}:", ("🧠 Cognitive Dissonance Pattern:",)),
        P("checkmark_cross_pairs", "", r"(?:✅|✔️|❌|⚠️|🔑|💡|🚀|📌|🎯|🔥|✨)", ("✅ Pros / ❌ Cons",)),
    )),
    Category("formatting_tells", "Structural formatting tells", "medium", 6, 30, "Habits of chat markup that stayed in a document.", "Legitimate choices where the house style allows them.", (
        P("inline_header_list", "m", r"^[ \t]*(?:[-*+]|\d+\.)\s+\*\*[^*\n]{2,60}\*\*\s*[:—-]", ("- **Scalability**: handles growth gracefully",)),
        P("title_case_heading", "m", r"^[ \t]*#{2,6}\s+(?:[A-Z][a-z']+\s+){2,}[A-Z][a-z']+\s*$", ("### Early Career And Professional Development",)),
        P("thematic_break_spam", "m", r"^[ \t]*(?:---|\*\*\*|___)\s*$", ("---",)),
        P("bold_lead_in", "m", r"^[ \t]*\*\*[^*\n]{2,60}\*\*\s*$", ("**Key considerations**",)),
        P("heading_then_heading", "m", r"^[ \t]*#{1,3}\s+[^\n]{1,60}\n+[ \t]*#{2,4}\s+", ("# Overview\n## Background",)),
    )),
)

BY_ID = {c.id: c for c in CATEGORIES}
PATTERN_INDEX = {f"{c.id}.{p.id}": p for c in CATEGORIES for p in c.patterns}


def ordinals() -> list[tuple[int, int, Category, Pattern]]:
    return [(i, j, c, p) for i, c in enumerate(CATEGORIES) for j, p in enumerate(c.patterns)]
