"""Fixed word lists."""

# The stop list of lemmas.
STOPWORDS = """
the a an this that these those
i you he she it we they them my your his her its our their
myself yourself himself herself itself ourselves themselves who whom which what whose
be have do will would shall should may might must can could go get make take come see know think give find tell
become leave feel put bring begin keep hold write stand seem turn show try call ask need let mean say use want
work look help endow
of in to for with on at from by about as into through during before after above below between under since without
within along among and or but if then than so because while where when why how
not no yes very too also well only just now here there up down out over again even still back more most much
any some all both each few many other such own
thing something anything everything nothing someone anyone everyone way time one two first second last part place
case fact point number
""".split() + ["no one"]

# Pieces of contractions.
CONTRACTION_FRAGMENTS = ["'s", "'t", "'m", "'d", "'ll", "'ve", "'re", "n't", "wo", "ca", "na", "ta", "gon", "wan", "got", "ng"]

# Forms of copulas and the prepositions that relations are read from.
COPULAS = "is are was were be being been becomes become became seems seem appeared appears".split()
PREPOSITIONS = "of from to in on at by with for through against between among within".split()
