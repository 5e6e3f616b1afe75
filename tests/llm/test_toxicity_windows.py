import zstandard

from folio.llm import toxicity


def test_distance_is_the_difference_of_two_compressed_lengths():
    shared, own = [b"the", b"house", b"of"], [b"vermin", b"rubbish"]
    model = toxicity.Model(b"".join(map(toxicity.code, shared)), b"".join(map(toxicity.code, shared + own)))
    distances = toxicity.Distances(model)
    text = "The house of vermin is not the house of cards; rubbish and more words so that two windows are needed. " + "x " * 9
    found = toxicity.words(text)
    assert distances.windows("") == [] and len(distances.windows(text)) == -(-len(found) // toxicity.WINDOW)
    for window, d in zip(distances.windows(text), distances.of(distances.windows(text))):
        sizes = []
        for content in (model.ordinary, model.toxic):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(coder.compress(window)))
        assert d == sizes[0] - sizes[1]
    assert max(distances.of(distances.windows(text))) >= toxicity.HIT
