"""A linear-chain conditional random field with two labels and hashed binary features."""

import numpy as np

LABELS = 2


class Field:
    """Weights: of each feature for label 1, of each step from label to label, of labels at both ends."""

    def __init__(self, size: int):
        self.feature = np.zeros(size)
        self.step = np.zeros((LABELS, LABELS))
        self.ends = np.zeros((2, LABELS))

    def packed(self) -> np.ndarray:
        return np.concatenate([self.feature, self.step.ravel(), self.ends.ravel()])

    @classmethod
    def unpacked(cls, values: np.ndarray) -> "Field":
        field = cls(len(values) - 2 * LABELS * LABELS)
        n = len(field.feature)
        field.feature = np.asarray(values[:n])
        field.step = np.asarray(values[n : n + 4]).reshape(LABELS, LABELS)
        field.ends = np.asarray(values[n + 4 :]).reshape(2, LABELS)
        return field

    def _local(self, sequence: list[list[int]]) -> np.ndarray:
        """Each place's weight for each label."""
        return np.array([(0.0, self.feature[place].sum()) for place in sequence])

    def viterbi(self, sequence: list[list[int]]) -> list[int]:
        """The likeliest labels; of equally likely ones, those with 0 earlier."""
        if not sequence:
            return []
        one = [float(self.feature[place].sum()) for place in sequence]
        (s00, s01), (s10, s11) = self.step.tolist()
        (a0, a1), (z0, z1) = self.ends.tolist()
        best0, best1, back = a0, a1 + one[0], []
        for x in one[1:]:
            from0, from1 = best0 + s01, best1 + s11
            to0, to1 = best0 + s00, best1 + s10
            back.append((0 if to0 >= to1 else 1, 0 if from0 >= from1 else 1))
            best0, best1 = max(to0, to1), max(from0, from1) + x
        labels = [0 if best0 + z0 >= best1 + z1 else 1]
        for pointers in reversed(back):
            labels.append(pointers[labels[-1]])
        return labels[::-1]

    def marginals(self, sequence: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Chances of each label at each place, and of each step between neighbours, by forward and backward sums."""
        local = self._local(sequence)
        local[0] += self.ends[0]
        local[-1] += self.ends[1]
        n, step = len(local), np.exp(self.step)
        weight = np.exp(local - local.max(axis=1, keepdims=True))
        ahead, behind = np.zeros((n, LABELS)), np.ones((n, LABELS))
        ahead[0] = weight[0] / weight[0].sum()
        for i in range(1, n):
            ahead[i] = ahead[i - 1] @ step * weight[i]
            ahead[i] /= ahead[i].sum()
        for i in range(n - 2, -1, -1):
            behind[i] = step @ (weight[i + 1] * behind[i + 1])
            behind[i] /= behind[i].sum()
        single = ahead * behind
        single /= single.sum(axis=1, keepdims=True)
        double = ahead[:-1, :, None] * step * (weight[1:] * behind[1:])[:, None, :]
        if n > 1:
            double /= double.sum(axis=(1, 2), keepdims=True)
        return single, double


def train(pages: list[tuple[list[list[int]], list[int]]], size: int, rounds: int = 8, rate: float = 0.3) -> Field:
    """The field that makes the labels of ``pages`` likely, by gradient steps of a size that shrinks per weight.

    Pages are taken in a fixed random order; weights are pulled to 0 a little at each use.
    """
    field, order = Field(size), np.random.default_rng(0)
    pages = [p for p in pages if p[0]]
    seen = Field(size)
    for weights in (seen.feature, seen.step, seen.ends):
        weights += 1.0
    for _ in range(rounds):
        for k in order.permutation(len(pages)):
            sequence, labels = pages[k]
            labels = np.array(labels)
            single, double = field.marginals(sequence)
            miss = labels - single[:, 1]
            for place, gap in zip(sequence, miss.tolist(), strict=True):
                slope = gap - 1e-4 * field.feature[place]
                seen.feature[place] += slope * slope
                field.feature[place] += rate * slope / np.sqrt(seen.feature[place])
            slope = -double.sum(axis=0)
            np.add.at(slope, (labels[:-1], labels[1:]), 1.0)
            slope -= 1e-3 * field.step
            seen.step += slope * slope
            field.step += rate * slope / np.sqrt(seen.step)
            slope = -np.stack([single[0], single[-1]])
            slope[0, labels[0]] += 1
            slope[1, labels[-1]] += 1
            slope -= 1e-3 * field.ends
            seen.ends += slope * slope
            field.ends += rate * slope / np.sqrt(seen.ends)
    return field
