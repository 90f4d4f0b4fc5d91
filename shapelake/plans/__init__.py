"""Models and iterative plans: kernels, Gaussian processes, shape models, registration and sampling."""
