"""Problem 8: score documents for abusive, hateful and sexual content.

Every word is folded: case, accents, zero-width characters, HTML entities, doubly encoded letters, look-alike letters
of other alphabets, digits and signs for letters, letters set apart by blanks or signs, stretched letters and starred
letters are brought to the word of the lexicon they stand for.  One Aho-Corasick automaton over the folded texts then
finds all words and phrases of a weighted lexicon in four languages, at word borders.

A sentence's score is the sum over kinds of content of the weights found: insults and belittling words with the
person they aim at, threats, groups of people together with what dehumanises them, sexual content.  Exception phrases
(words listed, quoted or discussed; remarks about oneself) take insults and sexual words away again.  In a sentence
of more than ``SPAN`` words only what stands within that many words is added up, which makes the score independent of
length; the density of a document is its sentences' scores per hundred words.  A document's score is that of its worst
sentence; from ``THRESHOLD`` on it is found.

Defined results: null, empty and blank texts score 0 and are kept; repeated rows score alike; all other columns stay.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, SPAN = 1.0, 40

# The lexicon: kind -> weight -> words and phrases, folded when loaded.  A trailing + also takes the plural in s.
LEXICON = {
    "insult": {
        0.6: "idiot+ moron+ imbecile+ cretin+ halfwit+ half-wit+ dipshit+ asshole+ arsehole+ bastard+ scumbag+ dumbass jackass bitch bitches whore+ slut+ "
        "cunt+ twat+ wanker+ prick+ dickhead+ shithead+ fuckface motherfucker+ fucker+ retard+ loser+ dimwit+ nitwit+ numbskull+ simpleton+ douchebag+ "
        "douche scum parasite+ parasit parasiten parasito+ lowlife lowlives degenerate+ dumbfuck airhead+ bonehead+ blockhead+ nutjob crackhead+ tosser+ bellend knobhead+ "
        "vollidiot vollidioten idioten arschloch arschlocher wichser hurensohn schlampe fotze missgeburt versager trottel depp deppen dummkopf schwachkopf "
        "drecksau drecksack penner spast volltrottel vollpfosten hirni mistkerl miststuck "
        "imbecil imbeciles idiota+ gilipollas cabron cabrones puta+ zorra+ pendejo+ subnormal maricon capullo+ hijoputa malparido+ tarado+ inutil "
        "connard+ connasse+ salope+ salaud+ abruti+ enculé+ batard+ debile+ pute+ ordure+ enfoire+ trouduc crétin+",
        0.4: "pig+ clown+ fool+ basura cochon+ sau tonto+ tonta+",
    },
    "slur": {1.0: "faggot+ nigger+ kike+ spic+ tranny trannies kanake kanaken neger negre+ sudaca+ bougnoule+ youpin+"},
    "mean": {
        0.4: "stupid worthless pathetic useless brainless disgusting filthy despicable witless spineless dummes dumme dumm wertlos wertloses wertlose "
        "erbarmlich nutzlos estupido estupida patetico patetica stupide minable lamentable merde scheisse mierda shit",
    },
    "aim": {
        0.4: "you your yours youre ur u yourself like_you hey du dich dir dein deine deinem deinen tu toi te ton ta eres ti vous usted vosotros ihr euch "
        "an_idiot_like a_moron_like",
        0.5: "whoever_wrote whoever_made whoever_approved whoever_merged wer_das_geschrieben quien_escribio celui_qui_a_ecrit",
    },
    "threat": {
        1.0: "kys kill_yourself hang_yourself go_die drop_dead fuck_you fuck_yourself fuck_off find_out_where_you_live find_you_and know_where_you_live "
        "know_where_you_work which_train_you_take beat_the_crap_out_of beat_the_shit_out_of kick_your_teeth break_your_fingers break_your_legs "
        "break_your_neck break_your_face smash_your_face cut_your_throat slit_your_throat i_will_kill_you ill_kill_you i_ll_kill_you gonna_kill_you "
        "hope_you_choke hope_you_die hope_you_get_cancer hope_you_rot hope_you_burn burn_in_hell rot_in_hell never_have_been_born "
        "stopped_breathing more_brain_than_you more_brains_than_you smarter_than_you_will_ever "
        "halt_die_fresse verpiss_dich fick_dich wo_du_wohnst bring_dich_um geh_sterben stirb_endlich leck_mich hau_dir_in_die ich_finde_dich "
        "ferme_ta_gueule nique_ta_mere va_te_faire va_mourir va_crever ou_tu_habites je_vais_te_tuer te_casser_la te_peter_la "
        "donde_vives romper_la_cara te_voy_a_matar te_voy_a_romper hijo_de_puta hija_de_puta vete_a_la_mierda muerete ojala_te_mueras que_te_jodan",
        0.8: "screw_you waste_of_oxygen waste_of_space waste_of_skin pedazo_de_basura pedazo_de_mierda pauvre_merde ta_gueule halt_die_klappe halts_maul halt_s_maul "
        "personne_ne_veut_de_toi nobody_wants_you no_one_wants_you stuck_scheisse piece_of_shit pieces_of_shit piece_of_garbage piece_of_trash",
        0.6: "shut_up shut_your nobody_would_miss_you no_one_would_miss_you do_the_world_a_favour do_the_world_a_favor you_will_regret youll_regret "
        "watch_your_back must_be_ashamed ashamed_to_have failure_of_a_human despises_you despise_you hates_you everybody_hates "
        "callate cierra_la_boca ferme_la tu_vas_le_payer lo_vas_a_pagar das_wirst_du_bereuen sollte_man_wegsperren wegsperren "
        "never_touch_a_keyboard pass_auf_dich_auf should_be_shot deserve_to_die deserves_to_die",
    },
    "group": {
        0.5: "women woman girls females feminists immigrant+ migrant+ refugee+ foreigner+ gays lesbians gay_people homosexuals trans_people transgender_people "
        "transsexuals disabled_people disabled cripples old_people elderly the_poor poor_people homeless_people muslim+ jews jewish_people christians "
        "catholics hindus blacks black_people brown_people whites white_people asians mexicans arabs africans indians chinese_people gypsies roma "
        "religion those_people these_people their_kind minorities young_people fat_people autistic_people "
        "auslander fluchtlinge migranten einwanderer frauen schwule lesben behinderte juden muslime zigeuner turken alte_leute arme "
        "inmigrantes extranjeros mujeres refugiados gitanos judios musulmanes negros discapacitados maricones los_pobres viejos "
        "etrangers immigres femmes refugies juifs musulmans arabes noirs gitans handicapes les_pauvres homosexuels they_are_all they_are_too",
    },
    "dehumanise": {
        0.6: "vermin subhuman+ sub-human+ untermensch untermenschen ungeziefer cockroach cockroaches a_disease a_plague a_cancer a_virus thieves_by_nature "
        "criminals_by_nature liars_by_nature lazy_by_nature stupid_by_nature belong_in_the_kitchen belong_in_a_cage belongs_in_the_kitchen are_animals "
        "inferior_race inferior too_stupid_to too_dumb_to go_back_to_where back_to_their_country deserve_no_rights exterminate exterminated gas_them una_plaga plaga vermine racaille "
        "sont_de_la dreck abschaum parasiten que_se_larguen nichts_verloren son_basura hang_them",
        0.5: "by_nature in_a_cage kept_out_of ruin_everything allowed_to_speak allowed_to_vote allowed_to_code no_wonder_it_broke no_wonder_it refuse_to_take should_be_deported "
        "deport deported not_welcome_here dont_belong do_not_belong should_not_be_allowed are_disgusting raus_mit fuera_de dehors",
        0.4: "was_better_before were_better_before get_rid_of send_all send_them_back send_the once_and_for_all all_the_same not_real_people",
    },
    "sexual": {
        1.0: "touching_myself have_sex_with_you having_sex_with_you are_you_naked suck_my want_to_fuck send_nudes blowjob+ masturbating deepthroat gangbang+ "
        "photos_de_toi_nue fotos_desnuda fotos_desnudo nacktbilder nacktfotos photos_nues follar fotos_tuyas_desnuda",
        0.8: "pushed_himself_inside bend_you_over used_panties naked_right_now cumshot+ handjob+ creampie milf+ masturbate masturbation sexting geile_sau fuck_me lick_my on_your_tits",
        0.7: "great_ass nice_ass sexy_ass nice_tits rip_off_your_clothes tear_off_your_clothes take_off_your_clothes breasts_were_bare bare_breasts hot_singles explicit_clips nudes "
        "hardcore_porn porn_videos horny orgasm+ nude_photos nude_pics naked_photos naked_pictures camgirl+ sex_videos geil_auf bite_hart",
        0.6: "porn porno pornos pussy tits boobs cock+ dildo+ erection ejaculate ejaculation oral_sex anal_sex sexy_girls desnuda desnudo",
        0.4: "hardcore moaning moaned xxx uncensored cams dick+ inside_her inside_him nue nackt geil geile cum erotic escort+ fuck fucking nipples",
        0.3: "send_me send_us",
        0.2: "naked nude sex sexual adults_only dm_me panties schick_mir mandame envoie_moi breasts bare",
    },
    "quoted": {
        1.0: "the_word the_words words_like words_such terms_like terms_such calling_people calling_someone forbid_calling rules_forbid called_me calls_me called_him called_her hate_speech ban_hate "
        "toxic_test test_set block_list blocklist word_list wordlist stop_list is_filtered are_filtered is_blocked are_blocked filter_rule filter_rules report_abuse "
        "sex_education das_wort die_worter wortliste sperrliste la_palabra las_palabras lista_de_palabras le_mot les_mots liste_de_mots is_flagged are_flagged flags_the",
    },
    "self": {
        1.0: "i_was_stupid i_am_stupid i_m_stupid im_stupid i_feel_stupid stupid_me i_was_an i_am_an i_m_an im_an i_was_a i_am_a i_m_a im_a i_am_such i_was_such my_stupid i_was_so i_am_so "
        "i_was_too i_feel_like ich_idiot ich_bin ich_war ich_trottel soy_un soy_una fui_un je_suis j_etais sorry_i yo_soy idiot_me silly_me my_own i_must_be",
    },
}
_LOOKALIKE = str.maketrans(
    dict(
        zip(
            "аеорсухіѕјԁһкмтвнгьїґӏєαεορικντυχηωıɡɑⅼǀ",
            "aeopcyxisjdhkmtbhrbirleaeopikvtuxnwigall",
        )
    )
    | {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "’": "'"}
)
_LEET = [str.maketrans("013457890@$!|+", "oieastbgoasiit"), str.maketrans("013457890@$!|+", "oleastbgoaslit")]
_HIDDEN = re.compile("[­͏؜ᅟ᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_TWICE = re.compile("[ÂÃ][\u0080-¿]")
_APART = re.compile(r"(?<= )(?:[a-z0-9] ){2,}[a-z0-9](?= )")
_SPELLED = re.compile(r"(?:[^\W_][-._*~+/|]){2,}[^\W_]")
_RUN = re.compile(r"(.)\1+")
_END = re.compile(r"[.!?…]+[\"')\]*_>]*$")
_CACHE_WORDS = 200_000


def _plain(text: str) -> str:
    """Lower case letters without accents or look-alikes."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_LOOKALIKE)) if not unicodedata.combining(c)).translate(_LOOKALIKE)
    return text


class Matcher:
    """The lexicon's automaton and the words its foldings lead to."""

    def __init__(self, lexicon=LEXICON):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        self.words: set[str] = set()
        strong: dict[str, float] = {}
        alone: set[str] = set()
        for kind, by_weight in lexicon.items():
            for weight, listed in by_weight.items():
                for entry in listed.split():
                    bare = " ".join(re.sub(r"[^a-z0-9 ]", " ", _plain(entry.rstrip("+").replace("_", " "))).split())
                    for form in [bare, bare + "s"] if entry.endswith("+") else [bare]:
                        entries.setdefault(form, []).append((kind, weight))
                        self.words.update(form.split())
                        if kind in ("insult", "slur", "mean", "threat", "dehumanise", "sexual"):
                            for w in form.split():
                                if len(w) > 2:
                                    alone.update({w} if w == form else ())
                                    strong[w] = max(strong.get(w, 0), weight)
        for form, kinds in entries.items():
            self.automaton.add_word(f" {form} ", (len(form.split()), form, kinds))
        self.automaton.make_automaton()
        self.strong = {w: s + (w in alone) for w, s in strong.items()}
        self.once = {}
        for w in sorted(strong, key=lambda w: (strong[w], w)):
            self.once[_RUN.sub(r"\1", w)] = w
        self.by_mask: dict[tuple, list[str]] = {}
        for w in strong:
            if len(w) > 3:
                self.by_mask.setdefault((len(w), w[0]), []).append(w)
        self.cache: dict[str, str] = {}

    def known(self, word: str) -> str | None:
        """The lexicon's word that this spelling, perhaps with stretched letters, stands for."""
        if word in self.words:
            return word
        once = _RUN.sub(r"\1", word)
        if once != word and (len(once) >= 4 or len(once) >= 2 and re.search(r"(.)\1\1", word)):
            return self.once.get(once)
        return None

    def masked(self, word: str) -> str | None:
        shape = re.compile(re.sub(r"[*#_]", "[a-z]", re.sub(r"[^a-z0-9*#_]", "", word)))
        fits = [w for w in self.by_mask.get((len(word), word[0]), ()) if shape.fullmatch(w)]
        return max(fits, key=lambda w: (self.strong[w], w)) if fits else None

    def fold(self, raw: str) -> str:
        ends = " ." if _END.search(raw) else ""
        word = _plain(raw).strip("\"'`()[]{}<>,;:.…_~|¿¡«»“”„")
        core = word.strip("!?*#-+/\\")
        if core.isalpha() and core.isascii():
            return (self.known(core) or core) + ends
        if "*" in word or "#" in core:
            starred = word.strip("!?-+/\\#")
            if starred[:1].isalpha() and (hit := self.masked(starred) or self.masked(core)):
                return hit + ends
        if _SPELLED.fullmatch(core):
            letters = re.sub(r"[\W_]", "", core)
            if hit := self.known(letters) or next(filter(None, (self.known(letters.translate(t)) for t in _LEET)), None):
                return hit + ends
        if re.search("[a-z]", word) and re.search(r"[0-9@$!|+]", word):
            for form in (core, word):
                for table in _LEET:
                    if (form := form.translate(table)).isalpha() and (hit := self.known(form)):
                        return hit + ends
        parts = re.findall("[a-z0-9]+", core)
        return " ".join(self.known(p) or p for p in parts) + ends if parts else ends.strip()

    def folded(self, text: str) -> str:
        if "&" in text:
            text = html.unescape(text)
        if not text.isascii():
            text = _HIDDEN.sub("", text)
            if "Ã" in text or "Â" in text:
                text = _TWICE.sub(lambda m: m.group().encode("latin-1").decode("utf-8", "replace"), text)
        cache = self.cache
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        out = []
        for w in text.replace("\n", " . ").split():
            f = cache.get(w)
            if f is None:
                f = cache[w] = self.fold(w)
            out.append(f)
        line = " " + " ".join(out) + " "
        return _APART.sub(self._joined, line)

    def _joined(self, m) -> str:
        letters = m.group().replace(" ", "")
        for low in range(min(3, len(letters))):
            for high in range(len(letters), max(low + 2, len(letters) - 3), -1):
                part = letters[low:high]
                for form in (part, *(part.translate(t) for t in _LEET)):
                    if len(form) > 2 and (hit := self.known(form)):
                        return " ".join([*letters[:low], hit, *letters[high:]])
        return m.group()

    def hits(self, line: str) -> list[tuple[int, int, list]]:
        """(sentence, word number, kinds) of every match, longest matches first where one begins inside another."""
        found = [(end - len(form) - 1, end, form, kinds) for end, (_, form, kinds) in self.automaton.iter(line)]
        if not found:
            return []
        stops, at = [], line.find(" . ")
        while at >= 0:
            stops.append(at)
            at = line.find(" . ", at + 2)
        out, position, words, sentence = [], 0, 0, 0
        for start, _, _, kinds in sorted(found, key=lambda x: (x[0], -x[1])):
            words += line.count(" ", position, start)
            position = start
            while sentence < len(stops) and stops[sentence] < start:
                sentence += 1
            out.append((sentence, words, kinds))
        return out

    def score(self, text: str) -> tuple[float, float, str | None]:
        """The worst sentence's score, the density and the kind that weighs most in the worst sentence."""
        line = self.folded(text)
        worst, kind, total = 0.0, None, 0.0
        by_sentence: dict[int, list] = {}
        for sentence, word, kinds in self.hits(line):
            by_sentence.setdefault(sentence, []).append((word, kinds))
        for hits in by_sentence.values():
            best = (0.0, None)
            if hits[-1][0] - hits[0][0] <= SPAN:
                best = weigh(hits)
            else:
                high = 0
                for low in range(len(hits)):
                    while high < len(hits) and hits[high][0] - hits[low][0] <= SPAN:
                        high += 1
                    best = max(best, weigh(hits[low:high]), key=lambda x: x[0])
            total += best[0]
            if best[0] > worst:
                worst, kind = best
        words = max(1, line.count(" ") - 1)
        return round(worst, 4), round(100 * total / words, 4), kind


def weigh(hits) -> tuple[float, str | None]:
    """The score of the hits [(word number, [(kind, weight)])] of one sentence, and the kind that weighs most."""
    best: dict[str, float] = {}
    adding: dict[str, float] = {}
    last = {}
    for word, kinds in hits:
        for kind, weight in kinds:
            best[kind] = max(best.get(kind, 0.0), weight)
            if kind in ("sexual", "dehumanise", "threat") and last.get(kind, -9) != word:
                adding[kind] = adding.get(kind, 0.0) + weight
                last[kind] = word
    insult = best.get("insult", 0.0) + best.get("mean", 0.0)
    sexual, threat, slur = adding.get("sexual", 0.0), adding.get("threat", 0.0), best.get("slur", 0.0)
    hate = adding.get("dehumanise", 0.0)
    hate = hate + best["group"] if hate and "group" in best else 0.0
    if "quoted" in best:
        insult, sexual, slur = (max(0.0, x - 1.0) for x in (insult, sexual, slur))
    if "self" in best:
        insult = max(0.0, insult - 1.0)
    aimed = insult if insult >= 0.6 or threat else insult / 2
    kinds = {"insult": aimed + slur, "threat": threat, "hate": hate, "sexual": sexual}
    base = sum(kinds.values())
    if base and (aimed or slur or threat or sexual >= 0.4):
        base += best.get("aim", 0.0)
    return base, max(kinds, key=lambda k: kinds[k]) if base else None


@lru_cache(maxsize=1)
def matcher() -> Matcher:
    return Matcher()


def scored(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``abuse``, a struct of ``score``, ``density`` and ``kind``, in place of a column of that name; no
    shuffle, no row is lost."""

    @F.pandas_udf("score double, density double, kind string")
    def score(column: pd.Series) -> pd.DataFrame:
        m = matcher()
        return pd.DataFrame([m.score(t) if t else (0.0, 0.0, None) for t in column], columns=["score", "density", "kind"])

    return df.withColumn("abuse", score(F.col(text)))


def rates(df: DataFrame, source: str = "source", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every source, null among them, with its documents, those found, and their rate; summed before the shuffle."""
    found = F.col("abuse.score") >= threshold
    return (
        scored(df.select(source, text), text)
        .groupBy(source)
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if(found).alias("found"), F.round(F.avg("abuse.score"), 6).alias("mean_score"))
        .withColumn("rate", F.round(F.col("found") / F.col("documents"), 6))
    )
